"""Cleaning, scaling, balancing and splitting of rows drawn from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import prep as H
from flowlens.plans.registry import query, rd, rounded
from flowlens.sources.adapters import PACKETS_SQL, RAW_SQL, packets, raw_samples, table

_PICK = "md5('42:' || id)"


def rows(spark, d):
    return raw_samples(spark, d).select("id", "packet_size", "payload_entropy", "protocol", "label")


_ROWS = f"{RAW_SQL}, r AS (SELECT id, packet_size, payload_entropy, protocol, label FROM raw)"
_RANKED = f"{_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_PICK}, id) AS rn, count(*) OVER (PARTITION BY label) AS c FROM r)"


@query("clean_data", f"""WITH {PACKETS_SQL} SELECT packet_id, greatest(k - 20, 0) AS packet_count, CAST(k AS DOUBLE) AS byte_count,
  k - 50 AS other, label FROM (SELECT *, CASE WHEN k < 8 THEN 1 ELSE 0 END AS label FROM packets)""")
def _clean(spark, d):
    p = packets(spark, d).select(
        "packet_id", "src_ip", "dst_ip", (F.col("k") - 20).alias("packet_count"), F.col("k").cast("string").alias("byte_count"),
        (F.col("k") - 50).alias("other"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("note"),
        (F.col("k") < 8).cast("double").alias("label"),
    )
    return H.clean(p)


@query("median_imputation", f"""WITH {PACKETS_SQL},
v AS (SELECT packet_id, CASE WHEN k % 4 <> 0 THEN length END AS a, CASE WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) / 3 - 10 END AS b FROM packets),
m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM v)
SELECT packet_id, {rd('coalesce(a, ma)', 'a')}, {rd('coalesce(b, mb)', 'b')} FROM v, m""")
def _median(spark, d):
    p = packets(spark, d).select(
        "packet_id", F.when(F.col("k") % 4 != 0, F.col("length")).alias("a"),
        F.when(F.col("k") % 7 != 0, F.col("k").cast("double") / 3 - 10).alias("b"),
    )
    return rounded(H.impute_median(p, ["a", "b"]))


@query("exact_medians", f"""SELECT 'l_quantity' AS feature, {rd('quantile_cont(l_quantity, 0.5)', 'median')} FROM lineitem
UNION ALL SELECT 'l_extendedprice', {rd('quantile_cont(l_extendedprice, 0.5)', 'median')} FROM lineitem
UNION ALL SELECT 'l_discount', {rd('quantile_cont(l_discount, 0.5)', 'median')} FROM lineitem""")
def _medians(spark, d):
    return rounded(H.exact_medians(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


_NUM = ["l_quantity", "l_extendedprice", "l_tax"]


@query("standardize", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    rd(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", c) for c in _NUM) + ", 0.0::DOUBLE AS constant FROM lineitem")
def _standardize(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_NUM, F.lit(7.0).alias("constant"))
    return rounded(H.standardize(li, [*_NUM, "constant"]))


@query("min_max", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    rd(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) * 2 - 1", c) for c in _NUM)
    + ", -1.0::DOUBLE AS constant FROM lineitem")
def _min_max(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *_NUM, F.lit(7.0).alias("constant"))
    return rounded(H.normalize(li, [*_NUM, "constant"], lo=-1.0, hi=1.0))


@query("fit_then_transform", """WITH f AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS s FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, l_linenumber, """ + rd("(l_tax - m) / s", "l_tax") + " FROM lineitem, f WHERE l_linestatus <> 'F'")
def _fit(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_linestatus")
    _, fitted = H.preprocess(li.where("l_linestatus = 'F'"), ["l_tax"])
    out, _ = H.preprocess(li.where("l_linestatus <> 'F'"), ["l_tax"], fitted)
    return rounded(out.drop("l_linestatus"))


@query("one_hot", """WITH m AS (SELECT l_returnflag AS f FROM lineitem WHERE l_quantity < 40 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 40 THEN l_returnflag ELSE f END AS v FROM lineitem, m)
SELECT l_orderkey, l_linenumber, CAST(v = 'A' AS INT)::DOUBLE AS flag_A, CAST(v = 'N' AS INT)::DOUBLE AS flag_N,
  CAST(v = 'Z' AS INT)::DOUBLE AS flag_Z FROM x""")
def _one_hot(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") < 40, F.col("l_returnflag")).alias("flag")
    )
    return H.one_hot(H.impute_mode(li, "flag"), "flag", ["A", "N", "Z"])


@query("downsample_majority", f"WITH {_RANKED} SELECT id, label FROM n WHERE label = 1 OR rn <= (SELECT count(*) FROM r WHERE label = 1)")
def _down(spark, d):
    return H.downsample_majority(rows(spark, d), "id").select("id", "label")


@query("undersample", f"WITH {_RANKED} SELECT id, label FROM n WHERE rn <= (SELECT min(c) FROM n)")
def _under(spark, d):
    return H.undersample(rows(spark, d), "id").select("id", "label")


# Every seventh row has lost its label: the quota is that of the labelled rows.
@query("undersample_unlabelled", f"""WITH {_ROWS}, l AS (SELECT id, label FROM r WHERE id % 7 <> 0),
q AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM l GROUP BY label))
SELECT id, label FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_PICK}, id) <= (SELECT c FROM q)
UNION ALL SELECT id, NULL FROM r WHERE id % 7 = 0""")
def _under_unlabelled(spark, d):
    known = rows(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("label")).alias("label"))
    return H.undersample(known, "id").unionByName(H.unlabelled(known)).select("id", "label")


@query("oversample", f"""WITH {_RANKED}, t AS (SELECT max(c) AS top FROM n)
SELECT id, label, unnest(range(1, CAST(top // c + CASE WHEN rn <= top % c THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM n, t""")
def _over(spark, d):
    return H.oversample(rows(spark, d), "id").select("id", "label", "copy")


@query("stratified_split", f"WITH {_RANKED} SELECT id, label, rn <= c * 80 // 100 AS is_train FROM n")
def _split(spark, d):
    return H.stratified_split(rows(spark, d), "id").select("id", "label", "is_train")


@query("random_split", f"""WITH {_ROWS} SELECT id, row_number() OVER (ORDER BY {_PICK}, id) <= count(*) OVER () * 80 // 100 AS is_first FROM r""")
def _random(spark, d):
    return H.random_split(rows(spark, d), "id").select("id", "is_first")


@query("holdout", f"""WITH {_ROWS} SELECT id, row_number() OVER (ORDER BY {_PICK}, id) <= least(count(*) OVER () * 10 // 100, 1000) AS is_holdout FROM r""")
def _holdout(spark, d):
    return H.holdout(rows(spark, d), "id").select("id", "is_holdout")


@query("stratified_folds", f"WITH {_RANKED} SELECT id, label, CAST((rn - 1) % 5 AS INT) AS fold FROM n")
def _folds(spark, d):
    return H.stratified_folds(rows(spark, d), "id").select("id", "label", "fold")


@query("class_weights", f"WITH {_RANKED} SELECT id, label, {rd('count(*) OVER () / (2.0 * c)', 'weight')} FROM n")
def _weights(spark, d):
    return rounded(H.class_weights(rows(spark, d), "label").select("id", "label", "weight"))


@query("large_groups", """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 600)""")
def _groups(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return H.large_groups(li, "l_suppkey", 600)


@query("deduplicate", f"WITH {_ROWS} SELECT min(id) AS id, packet_size, protocol, label FROM r GROUP BY packet_size, protocol, label")
def _dedup(spark, d):
    r = rows(spark, d).select("id", "packet_size", "protocol", "label")
    return H.deduplicate(r, ["packet_size", "protocol", "label"], "id")


@query("training_columns", f"""WITH {RAW_SQL} SELECT CAST(packet_size AS DOUBLE) AS packet_count, CAST(packet_size AS DOUBLE) AS byte_count, label FROM raw""")
def _training(spark, d):
    from flowlens.functions.scalars import raw_to_model

    return H.require_label(raw_to_model(raw_samples(spark, d))).select("packet_count", "byte_count", "label")
