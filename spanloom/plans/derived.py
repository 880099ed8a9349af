"""Inputs derived from the driver's tables by rules that Spark and SQL state alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table

# gold and predicted spans from lineitem
GOLD_SQL = "select l_orderkey as example, cast((l_partkey % 40) * 3 as int) as start, cast((l_partkey % 40) * 3 + 2 + l_suppkey % 4 as int) as stop, l_returnflag as label, concat('t ', l_partkey % 50) as text, l_linenumber as line from lineitem where l_linenumber % 2 = 1"
PREDICTED_SQL = "select l_orderkey as example, cast((l_partkey % 40) * 3 + case when l_suppkey % 5 = 0 then 1 else 0 end as int) as start, cast((l_partkey % 40) * 3 + 2 + l_suppkey % 4 as int) as stop, case when l_suppkey % 7 = 0 then 'X' else l_returnflag end as label, concat('t  ', l_partkey % 50) as text, l_linenumber as line from lineitem where l_linenumber % 3 <> 0"
# runs, spans and confidences from events
VOTES_SQL = "select event_type as run, user_id % 40 as doc, cast(event_id % 12 as int) as start, cast(event_id % 12 + 3 as int) as stop, case when event_id % 5 = 0 then 'PER' else 'LOC' end as type, concat('s', event_id % 12) as text, event_id from events"
SCORES_SQL = "select user_id as doc, event_id as id, cast(event_id % 300 as int) as start, event_id as pos, case when event_id % 11 = 0 then null else cast(cast(event_id % 97 as double) / 100 as double) end as confidence, case when event_id % 13 = 0 then 'deleted' when event_id % 3 = 0 then 'confirmed' else 'pending' end as status, event_type as type from events"
# a review log from orders
REVIEW_SQL = "select o_custkey % 100 as doc, o_orderkey as id, case when o_orderkey % 9 = 0 then 'human' else 'model' end as source, case o_orderstatus when 'F' then 'confirmed' when 'O' then 'edited' else 'deleted' end as status, o_orderpriority as type, case when o_orderkey % 10 = 0 then null else o_totalprice / 500000 end as confidence from orders"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over one of the tables, without registering a view under its name."""
    name = sql.rpartition(" from ")[2].split()[0]
    return spark.sql(sql.replace(f" from {name}", " from {source}"), source=table(spark, sf_dir, name))
