"""Names of entity tags by number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tags of the entity corpus in the order of their numbers; 0 is no entity.
COARSE = ["O", "art", "building", "event", "location", "organization", "other", "person", "product"]
FINE = [
    "O",
    "art-broadcastprogram", "art-film", "art-music", "art-other", "art-painting", "art-writtenart",
    "building-airport", "building-hospital", "building-hotel", "building-library", "building-other", "building-restaurant", "building-sportsfacility", "building-theater",
    "event-attack/battle/war/militaryconflict", "event-disaster", "event-election", "event-other", "event-protest", "event-sportsevent",
    "location-GPE", "location-bodiesofwater", "location-island", "location-mountain", "location-other", "location-park", "location-road/railway/highway/transit", "location-star", "location-zip",
    "organization-company", "organization-education", "organization-government/governmentagency", "organization-media/newspaper", "organization-other", "organization-politicalparty", "organization-religion", "organization-showorganization", "organization-sportsleague", "organization-sportsteam",
    "other-astronomything", "other-award", "other-biologything", "other-chemicalthing", "other-currency", "other-disease", "other-educationaldegree", "other-god", "other-language", "other-law", "other-livingthing", "other-medical",
    "person-actor", "person-artist/author", "person-athlete", "person-director", "person-other", "person-politician", "person-scholar", "person-soldier",
    "product-airplane", "product-car", "product-food", "product-game", "product-other", "product-ship", "product-software", "product-train", "product-weapon",
]
LOCATION = COARSE.index("location")


def name_of(tag: Column, names: list[str]) -> Column:
    """The tag's name; unknown-N for numbers outside the list."""
    return F.coalesce(F.get(F.array(*map(F.lit, names)), F.when(tag >= 0, tag)), F.concat(F.lit("unknown-"), tag.cast("string")))


def allowed(names: list[str]) -> list[str]:
    return names[1:]
