"""Further queries of the catalogue: scans and sinks, draws, the bootstrap's tree, parsers, gates and check sets."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import answers
from sievework.functions import textkeys as tk
from sievework.operators import asking, checks, eligibility, llmio, metrics, options, order_stats, pairs, rewards, splits, stats
from sievework.plans.queries import SEED, H, query
from sievework.plans.report import review_and_key
from sievework.sources import corpora, files, publish
from sievework.sources.work import shared_dir

# ---- scans and sinks, over tables written to the shared folder and read again


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, user_id FROM events")
def jsonl_round_trip(read) -> DataFrame:
    e = read("events").select("event_id", "event_type", "user_id")
    at = _folder(e, "jsonl")
    half = F.col("event_id") % 2 == 0
    files.write_jsonl(e.where(half), at)
    files.write_jsonl(e.where(~half), at, append=True)
    return files.read_jsonl(e.sparkSession, at, e.schema)


@query("SELECT doc_id, CAST(len(text) AS BIGINT) AS n, true AS gapless FROM documents WHERE text IS NOT NULL")
def numbered_records(read) -> DataFrame:
    d = read("documents").where("text is not null").select("doc_id", "text")
    at = _folder(d, "lines")
    d.write.json(at)
    rows = corpora.read_json_lines(d.sparkSession, at, "struct<doc_id:bigint,text:string>")
    whole = rows.groupBy("file").agg((F.count_distinct("row") == F.max("row") + 1).alias("gapless"))
    return rows.join(whole, "file").select("record.doc_id", F.length("record.text").cast("bigint").alias("n"), "gapless")


@query("SELECT count(*) - 1 AS last, CAST(count(*) AS BIGINT) AS n FROM events")
def positional_union(read) -> DataFrame:
    e = read("events").select("event_id", (F.col("event_id") % 3).alias("part"))
    parts = [e.where(F.col("part") == k).select(F.monotonically_increasing_id().alias("_m"), "event_id") for k in range(3)]
    from sievework.operators.ranks import order_ranked

    rows = [order_ranked(p, [], ["event_id"]).select("event_id", (F.col("_r") - 1).alias("row")) for p in parts]
    p = files.concat_positions(rows)
    return p.agg(F.max("position").alias("last"), F.count_distinct("position").alias("n"))


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_round_trip(read) -> DataFrame:
    c = read("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    at = _folder(c, "csv")
    c.write.csv(at, header=True)
    return files.read_csv(c.sparkSession, at, c.schema, ["c_custkey"])


@query("SELECT o_orderkey, o_orderpriority AS reference FROM orders")
def pinned_answers(read) -> DataFrame:
    o = read("orders").select("o_orderkey", F.concat(F.lit("so #### not yet #### "), "o_orderpriority", F.lit(" ")).alias("answer"))
    at = _folder(o, "pinned")
    o.write.parquet(at)
    return files.read_pinned(o.sparkSession, at, o.count(), "answer").select("o_orderkey", "reference")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE [lang, source] END AS parts FROM documents")
def string_lists(read) -> DataFrame:
    held = F.when(F.col("doc_id") % 3 == 0, F.lit("no list")).otherwise(F.to_json(F.array("lang", "source")))
    return read("documents").select("doc_id", files.string_list(held).alias("parts"))


@query("""SELECT 'own' AS dataset, doc_id, CASE WHEN trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' OR text IS NULL THEN 'missing_field:question' ELSE '' END AS exclusion_reason FROM documents""")
def mapped_records(read) -> DataFrame:
    d = read("documents").select(F.lit("f").alias("file"), F.col("doc_id").alias("row"), F.struct(F.col("text").alias("q"), F.lit("s").alias("a"), F.lit("l").alias("e")).alias("record"))
    got = corpora.from_map(d, {"question": "q", "incorrect_solution": "a", "source_error_label": "e"}, "own")
    return got.select("dataset", F.element_at(F.split("source_id", "#"), -1).cast("bigint").alias("doc_id"), "exclusion_reason")


@query("""SELECT 'stepwise' AS dataset, count(*) AS n, CAST(count_if(lang <> 'en') AS BIGINT) AS eligible FROM documents
UNION ALL SELECT 'mathclean', count(*), CAST(count_if(source = 'web') AS BIGINT) FROM documents""")
def pooled_corpora(read) -> DataFrame:
    d = read("documents")
    at = [F.lit("/data/sub/f.json").alias("file"), F.col("doc_id").alias("row")]
    label = F.when(F.col("lang") == "en", " None ").otherwise("Wrong step")
    one = d.select(*at, F.struct(F.lit("p").alias("problem"), F.lit('["a","b"]').alias("student_incorrect_solution"), label.alias("error_category"), F.lit(1).alias("incorrect_index"), F.lit("b").alias("incorrect_step"), F.lit("t").alias("topic")).alias("record"))
    kind = F.when(F.col("source") == "web", "Logic error").otherwise("correct")
    two = d.select(*at, F.struct(F.lit("p").alias("question"), F.lit("a").alias("answer"), kind.alias("type"), F.lit("x").alias("extent")).alias("record"))
    return corpora.pool_of({"stepwise": one, "mathclean": two}).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("eligible"))


@query(f"""SELECT row_number() OVER (ORDER BY {H.format("o_orderkey")}, o_orderkey) AS number, o_totalprice, o_orderkey, o_orderstatus FROM orders""")
def review_sheet(read) -> DataFrame:
    review, key = review_and_key(read("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderkey", ["o_orderstatus"], SEED)
    return review.join(key, "number")


@query("SELECT s_suppkey, s_nationkey, true AS wrong, sha256(s_name) AS text_sha256 FROM supplier WHERE s_suppkey IN (1, 3, 5)")
def fixed_examples(read) -> DataFrame:
    s = read("supplier").select("s_suppkey", "s_nationkey", "s_name", F.lit("train").alias("split"), F.lit(True).alias("wrong"))
    return eligibility.fixed_examples(s, "split", "train", [1, 3, 5], "s_suppkey", "s_name").select("s_suppkey", "s_nationkey", "wrong", "text_sha256")


# ---- draws

_DONOR = f"""WITH d AS (SELECT doc_id, lang, source, doc_id % 50 AS g, row_number() OVER (PARTITION BY lang ORDER BY source, doc_id % 50, {H.format("doc_id")}, doc_id) AS r FROM documents),
p AS (SELECT x.lang, x.doc_id AS anchor, x.source, y.doc_id AS donor, y.source AS donor_source, row_number() OVER (PARTITION BY x.doc_id ORDER BY y.r) - 1 AS k, count(*) OVER (PARTITION BY x.doc_id) AS n
 FROM d x JOIN d y ON x.lang = y.lang AND x.source <> y.source AND x.g <> y.g),
w AS (SELECT * FROM p WHERE k = CAST(('0x' || substr(sha256(concat_ws('|', '7', 'donor', anchor)), 1, 15)) AS BIGINT) % n)"""


def _drawn(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang", "source", (F.col("doc_id") % 50).alias("g"))
    return pairs.uniform_donors(d, ["lang"], "doc_id", "source", "g", SEED)


@query(_DONOR + " SELECT lang, anchor, donor FROM w")
def uniform_donors(read) -> DataFrame:
    return _drawn(read)


@query(_DONOR + " SELECT source AS anchor, donor_source AS donor, count(*) AS n FROM w GROUP BY 1, 2")
def drawn_donor_matrix(read) -> DataFrame:
    d = read("documents").select("doc_id", "source")
    named = _drawn(read).join(d.select(F.col("doc_id").alias("anchor"), F.col("source").alias("a")), "anchor").join(d.select(F.col("doc_id").alias("donor"), F.col("source").alias("b")), "donor")
    return named.groupBy(F.col("a").alias("anchor"), F.col("b").alias("donor")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH e AS (SELECT lang AS s, n_chars % 100 AS g, min({H.format("doc_id")}) AS h FROM documents GROUP BY 1, 2),
a AS (SELECT * FROM e WHERE s = 'de' ORDER BY h LIMIT 30), b AS (SELECT * FROM e WHERE s = 'en' AND g NOT IN (SELECT g FROM a) ORDER BY h LIMIT 20),
c AS (SELECT * FROM e WHERE s = 'es' AND g NOT IN (SELECT g FROM a UNION ALL SELECT g FROM b) ORDER BY h LIMIT 20),
d AS (SELECT * FROM e WHERE s = 'fr' AND g NOT IN (SELECT g FROM a UNION ALL SELECT g FROM b UNION ALL SELECT g FROM c) ORDER BY h LIMIT 40)
SELECT s AS stratum, g AS "group" FROM a UNION ALL SELECT s, g FROM b UNION ALL SELECT s, g FROM c UNION ALL SELECT s, g FROM d""")
def groups_in_order(read) -> DataFrame:
    d = read("documents").select(F.col("lang").alias("stratum"), (F.col("n_chars") % 100).alias("group"), tk.hash_rank(SEED, F.col("doc_id")).alias("order"))
    quotas = d.select("stratum").distinct().withColumn("quota", F.when(F.col("stratum") == "de", 30).when(F.col("stratum").isin("en", "es"), 20).when(F.col("stratum") == "fr", 40).otherwise(0))
    return splits.accepted(d, quotas)


def _counts(read) -> DataFrame:
    o = read("orders").select("o_orderkey", F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("model"))
    return read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("g", "model").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count(F.lit(1)).alias("b"))


@query()
def bootstrap_tree(read) -> DataFrame:
    return stats.interval(stats.tree_ratios(_counts(read), "g", ["model"], "a", "b", 1000, SEED), ["model"])


@query()
def paired_bootstrap_tree(read) -> DataFrame:
    return stats.tree_paired_difference(_counts(read), "g", "model", "1-URGENT", "a", "b", 1000, SEED)


# ---- parsers, gates, answers


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not_aligned' WHEN 1 THEN 'aligned' ELSE 'invalid' END AS strict,
 CASE event_id % 6 WHEN 0 THEN 'not_aligned' WHEN 1 THEN 'aligned' WHEN 2 THEN 'aligned' ELSE 'invalid' END AS lenient FROM events""")
def label_answers(read) -> DataFrame:
    said = ["not_aligned", " aligned\n", "It is Aligned.", "aligned or not_aligned", "misaligned", ""]
    text = F.get(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 6).cast("int"))
    labels = ["aligned", "not_aligned"]
    return read("events").select("event_id", tk.strict_label(text, labels).alias("strict"), tk.lenient_label(text, labels).alias("lenient"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'tie' END AS winner FROM events""")
def winner_answers(read) -> DataFrame:
    said = ['{"winner": "A"}', '{"winner": "tie"}', '{"winner": "C"}', "A", '{"winner": "B", "why": 1}']
    e = read("events").select("event_id", F.get(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 5).cast("int")).alias("said"))
    return answers.winner(e, "said").select("event_id", "winner")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'B' END AS matched_option FROM events""")
def match_answers(read) -> DataFrame:
    said = ['{"matched_option": " b", "reason": "r"}', '{"matched_option": "Z", "reason": "r"}', '{"matched_option": null, "reason": "r"}', "no"]
    e = read("events").select("event_id", F.get(F.array(*[F.lit(x) for x in said]), (F.col("event_id") % 4).cast("int")).alias("said"))
    return answers.match(e, "said", F.array(F.lit("A"), F.lit("B"))).select("event_id", "matched_option")


@query("""SELECT conv_id, turn, 'role: ' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN 'turn ' || turn || chr(10) ELSE '' END || 'end' AS prompt FROM conversations""")
def optional_lines(read) -> DataFrame:
    values = {"role": F.col("role"), "turn": F.when(F.col("turn") % 2 == 0, F.col("turn"))}
    return read("conversations").select("conv_id", "turn", tk.render_lines("role: {role}\nturn {turn}\nend", values).alias("prompt"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def judged_rows(read) -> DataFrame:
    o = read("orders").select("o_orderkey", "o_custkey")
    return eligibility.all_kept(o, o.select("o_orderkey", F.lit("KEEP").alias("decision")), "o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber % 2 AS t, max_by(l_quantity < 25, ((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + CAST(l_quantity AS BIGINT)) AS c FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey, count(DISTINCT t) AS k, min(CAST(c AS INT)) AS ok FROM l GROUP BY 1)
SELECT count(*) AS pairs, CAST(coalesce(sum(ok), 0) AS BIGINT) AS "right", CAST(sum(ok) AS DOUBLE) / count(*) AS pair_accuracy FROM p WHERE k = 2""")
def last_pair_accuracy(read) -> DataFrame:
    order = ((F.col("l_linenumber").cast("bigint") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")
    r = read("lineitem").select("l_orderkey", order.alias("o"), (F.col("l_linenumber") % 2).alias("t"), (F.col("l_quantity") < 25).alias("c"))
    return metrics.last_pair_accuracy(r, "l_orderkey", "t", "c", "o")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'incorrect' ELSE 'correct' END AS verdict, CASE WHEN event_id % 3 = 0 THEN event_type END AS labels FROM events""")
def scoring_cascade(read) -> DataFrame:
    e = read("events").select("event_id", "event_type")
    check = lambda d: d.withColumn("verdict", F.when(F.col("event_id") % 3 == 0, "incorrect").otherwise("correct"))
    same = lambda t: pd.Series(t, dtype=object)
    verify = lambda d: llmio.scored(d, same, "event_type", "labels").select("event_id", "labels")
    return llmio.cascade(e, check, verify, "event_id").select("event_id", "verdict", "labels")


@query("""SELECT 'score' AS "column", '0' AS fallback, count(*) AS n FROM events WHERE event_type = 'click' HAVING count(*) > 0""")
def refused_requests(read) -> DataFrame:
    e = read("events").select("event_id", F.lit(1).alias("score"), F.when(F.col("event_type") == "click", "refused").otherwise("ok").alias("status"))
    return llmio.with_fallback(e, "score", "status", 0)[1]


@query("""SELECT user_id, event_id, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) END AS aux FROM events""")
def auxiliary_scores(read) -> DataFrame:
    e = read("events").select("user_id", "event_id", F.when(F.col("event_type") == "click", "incorrect").otherwise("correct").alias("verdict"), (F.col("event_id") % 2 == 0).alias("accepted"))
    return rewards.with_aux(e, "user_id", "event_id", lambda d: d.select("user_id", "event_id", F.col("user_id").cast("double").alias("aux"))).select("user_id", "event_id", "aux")


# ---- check sets


@query("""WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0)
(SELECT o_orderkey FROM orders EXCEPT ALL (SELECT * FROM a UNION ALL SELECT * FROM b)) UNION ALL ((SELECT * FROM a UNION ALL SELECT * FROM b) EXCEPT ALL SELECT o_orderkey FROM orders)""")
def partition_gap(read) -> DataFrame:
    o = read("orders").select("o_orderkey")
    return checks.partition_gap(o, o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 <> 0"))


@query("SELECT DISTINCT coalesce(c_custkey, o_custkey) AS k FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey WHERE c_custkey IS NULL OR o_custkey IS NULL")
def keys_of_one_side(read) -> DataFrame:
    return checks.key_mismatch(read("customer").select(F.col("c_custkey").alias("k")), read("orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH h AS (SELECT o_orderkey, o_custkey, o_orderkey % 2 AS h FROM orders), g AS (SELECT o_custkey FROM h GROUP BY 1 HAVING count(DISTINCT h) > 1)
SELECT 'halves make up the whole' AS name, true AS passed, '0 violations' AS detail UNION ALL SELECT 'each id is in one half', true, '0 violations'
UNION ALL SELECT 'each group is in one half', count(*) = 0, count(*) || ' violations' FROM g""")
def halves_of_orders(read) -> DataFrame:
    o = read("orders").select("o_orderkey", "o_custkey")
    return checks.half_checks(o, o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_orderkey", "o_custkey")


def _half_tables(read) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases are documents in halves by group; each has a right pair, and a wrong one unless its number ends in 0."""
    group, half = F.col("doc_id") % 40, F.when(F.col("doc_id") % 40 < 20, "A").otherwise("B")
    c = read("documents").select(F.col("doc_id").alias("sample_id"), group.alias("question_group_id"), F.col("lang").alias("dataset"), half.alias("half"), F.col("source").alias("label"), F.coalesce("n_chars", F.lit(0)).alias("n_tokens"))
    own = lambda target: [F.lit(target).alias("target"), F.lit("train").alias("split"), "half", "dataset", F.col("sample_id").alias("anchor_sample_id")]
    rest = lambda donor, donor_group, label: [donor.alias("donor_sample_id"), "question_group_id", donor_group.alias("donor_question_group_id"), F.col("label").alias("anchor_source_error_label"), label.alias("donor_source_error_label"), "n_tokens"]
    right = c.select(*own("aligned"), *rest(F.col("sample_id"), F.col("question_group_id"), F.col("label")))
    wrong = c.where("sample_id % 10 <> 0").select(*own("not_aligned"), *rest(F.col("sample_id") + 3, (F.col("sample_id") + 3) % 40, F.lit("web")))
    return right.unionByName(wrong), c.select("sample_id", "question_group_id", "dataset", "half"), right.unionByName(wrong)


@query("""WITH c AS (SELECT doc_id AS i, doc_id % 40 AS g, lang AS d, CASE WHEN doc_id % 40 < 20 THEN 'A' ELSE 'B' END AS h, source AS l, coalesce(n_chars, 0) AS n FROM documents),
w AS (SELECT c.*, x.d AS dd, x.h AS dh FROM c LEFT JOIN c x ON x.i = c.i + 3 WHERE c.i % 10 <> 0), a AS (SELECT * FROM (VALUES ('A'), ('B')) t(half)),
v AS (SELECT half || '.self.unchanged' AS name, 0 AS k FROM a UNION ALL SELECT half || '.pair.train', 0 FROM a
 UNION ALL SELECT half || '.donor.half', count_if(h = half AND dh IS DISTINCT FROM h) FROM a, w GROUP BY half
 UNION ALL SELECT half || '.donor.label', count_if(h = half AND l = 'web') FROM a, w GROUP BY half
 UNION ALL SELECT half || '.donor.group', 0 FROM a
 UNION ALL SELECT half || '.donor.dataset', count_if(h = half AND dd IS DISTINCT FROM d) FROM a, w GROUP BY half
 UNION ALL SELECT half || '.text.length', count_if(h = half AND n > 2000) FROM a, (SELECT * FROM c UNION ALL SELECT * FROM c WHERE i % 10 <> 0) GROUP BY half
 UNION ALL SELECT half || '.anchor.targets', count_if(h = half AND i % 10 = 0) FROM a, c GROUP BY half
 UNION ALL SELECT * FROM (VALUES ('cut.whole', 0), ('cut.anchors', 0), ('cut.groups', 0)) t(name, k))
SELECT name, k = 0 AS passed, k || ' violations' AS detail FROM v""")
def half_expectations(read) -> DataFrame:
    source, cases, made = _half_tables(read)
    return checks.half_expectations(source, cases, made, 2000)


@query("""WITH d AS (SELECT doc_id AS i, doc_id % 30 AS g, doc_id % 4 AS t, CASE WHEN doc_id % 30 < 10 THEN 'train' WHEN doc_id % 30 < 20 THEN 'validation' ELSE 'test' END AS s FROM documents),
v AS (SELECT 'type.stage' AS name, count_if(t = 3) AS k FROM d UNION ALL SELECT 'type.unit', count_if(t = 2 AND i % 5 <> 0) FROM d UNION ALL SELECT 'group.listed', count_if(i % 11 = 0 AND s <> 'train') FROM d
 UNION ALL SELECT 'leak.test', count_if(g = 25) FROM d WHERE NOT (i % 11 = 0) UNION ALL SELECT 'leak.validation', count_if(g IN (12, 14, 16, 18)) FROM d WHERE NOT (i % 11 = 0)
 UNION ALL SELECT 'group.one', count(*) FROM (SELECT g FROM d GROUP BY g HAVING count(DISTINCT CASE WHEN i % 11 = 0 THEN 'train' ELSE s END) > 1))
SELECT name, k = 0 AS passed, k || ' violations' AS detail FROM v""")
def condition_expectations(read) -> DataFrame:
    d = read("documents")
    g, t = F.col("doc_id") % 30, F.col("doc_id") % 4
    split = F.when(g < 10, "train").when(g < 20, "validation").otherwise("test")
    c = d.select(
        split.alias("split"), g.alias("question_group_id"), t.alias("source_error_id"), F.when(t == 3, "late").otherwise("early").alias("stage"), (F.col("doc_id") % 5 == 0).alias("unit_conversion_eligible"),
        F.when(F.col("doc_id") % 11 == 0, "train").otherwise(split).alias("listed"),
    )
    groups = d.select(g.alias("group_id")).distinct().select("group_id", F.when(F.col("group_id") == 25, "A").alias("half"), ((F.col("group_id") >= 10) & (F.col("group_id") < 20) & (F.col("group_id") % 2 == 0) & (F.col("group_id") > 10)).alias("has_sft"))
    types = d.select(t.alias("type_id")).distinct().select("type_id", F.lit("early").alias("stage"), (F.col("type_id") == 2).alias("unit_related"))
    return checks.condition_expectations(c, groups, types)


@query("""WITH b AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS p FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'same.ids' AS name, count_if(b.o_orderkey IS NULL) = 0 AS passed, count_if(b.o_orderkey IS NULL) || ' violations' AS detail FROM orders a LEFT JOIN b USING (o_orderkey)
UNION ALL SELECT 'same.content', count_if(b.p IS DISTINCT FROM a.o_totalprice) = 0, count_if(b.p IS DISTINCT FROM a.o_totalprice) || ' violations' FROM orders a LEFT JOIN b USING (o_orderkey)""")
def same_rows(read) -> DataFrame:
    o = read("orders").select("o_orderkey", "o_totalprice")
    other = o.where("o_orderkey % 5 <> 0").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0))
    return checks.same_rows(o, other, "o_orderkey", ["o_totalprice"])


@query("""WITH d AS (SELECT doc_id AS i, doc_id % 30 AS g, doc_id % 4 AS own, coalesce(n_chars, 0) AS n, lang IS NOT NULL AND source IS NOT NULL AND doc_id % 17 <> 0 AS kept FROM documents),
p AS (SELECT *, 'aligned' AS target, own AS t FROM d UNION ALL SELECT *, 'not_aligned', (i + 1) % 5 FROM d WHERE i % 10 <> 0),
v AS (SELECT * FROM (VALUES ('type.own', 0), ('group.split', 0), ('group.half', 0)) x(name, k)
 UNION ALL SELECT 'type.other', count_if(target = 'not_aligned' AND t = own) FROM p UNION ALL SELECT 'type.adopted', count_if(t = 4) FROM p UNION ALL SELECT 'type.stage', count_if(t >= 3) FROM p
 UNION ALL SELECT 'type.unit', count_if(target = 'not_aligned' AND t = 2 AND i % 3 <> 0) FROM p UNION ALL SELECT 'text.own', count_if(NOT kept) FROM p
 UNION ALL SELECT 'draw.first', count_if(target = 'not_aligned' AND i % 7 = 0) FROM p UNION ALL SELECT 'text.length', count_if(n > 2000) FROM p UNION ALL SELECT 'anchor.targets', count_if(i % 10 = 0) FROM d
 UNION ALL SELECT 'group.region', count(DISTINCT g) FROM p WHERE g = 5 AND target = 'not_aligned' UNION ALL SELECT 'group.forced_train', count(DISTINCT g) FROM d WHERE g = 25 UNION ALL SELECT 'group.forced_a', count(DISTINCT g) FROM d WHERE g = 12)
SELECT name, k = 0 AS passed, k || ' violations' AS detail FROM v""")
def typed_expectations(read) -> DataFrame:
    d, i, g = read("documents"), F.col("doc_id"), F.col("doc_id") % 30
    group = F.col("group_id")
    groups = d.select(g.alias("group_id")).distinct().select(
        "group_id", F.when(group < 20, "train").otherwise("test").alias("split"), F.when(group < 10, "A").when(group < 20, "B").alias("half"),
        (group % 2 == 0).alias("has_sft"), group.isin(3, 25).alias("forced_train"), group.isin(2, 12).alias("forced_a"),
    )
    cases = d.select(i.alias("sample_id"), F.col("lang").alias("question"), F.col("source").alias("solution"))
    types = d.select((i % 4).alias("type_id")).distinct().select("type_id", F.when(F.col("type_id") == 3, "late").otherwise("early").alias("stage"), (F.col("type_id") == 2).alias("unit_related"))
    side = F.when(g < 20, "train").otherwise("test")

    def made(rows: DataFrame, target: str, kind, mark: str, region) -> DataFrame:
        return rows.select(
            F.concat(i.cast("string"), F.lit(mark)).alias("pair_id"), region.alias("region"), g.alias("question_group_id"), F.lit(target).alias("target"), i.alias("anchor_sample_id"), (i % 4).alias("anchor_error_id"),
            kind.alias("target_error_id"), F.lit("early").alias("target_stage"), (i % 3 == 0).alias("unit_conversion_eligible"), F.when(i % 7 == 0, "other_dataset").otherwise("same_dataset").alias("negative_dataset_relation"),
            F.lit("same_stage").alias("negative_kind"), F.when(i % 17 != 0, F.col("lang")).otherwise("another").alias("question"), F.col("source").alias("solution"), F.create_map(F.lit("x"), F.coalesce("n_chars", F.lit(0))).alias("n_tokens"),
        )

    right = made(d, "aligned", i % 4, "::pos", side)
    wrong = made(d.where("doc_id % 10 <> 0"), "not_aligned", (i + 1) % 5, "::neg", F.when(g == 5, "eval").otherwise(side))
    return checks.typed_expectations(groups, cases, right.unionByName(wrong), types, longest=2000)


# ---- order statistics, options, publishing


@query("""SELECT l_returnflag, count(*) AS n, CAST(list_sort(list(l_partkey))[1 + count(*) // 2] AS BIGINT) AS upper_median, quantile_disc(l_partkey, 0) AS least, quantile_disc(l_partkey, 1) AS most,
 CAST(list_sort(list(l_partkey))[1 + CAST(floor(0.9 * (count(*) - 1)) AS BIGINT)] AS BIGINT) AS p90 FROM lineitem GROUP BY 1""")
def order_values(read) -> DataFrame:
    places = {"upper_median": order_stats.upper_median, "least": lambda n: F.lit(0), "most": lambda n: n - 1, "p90": order_stats.at_share(0.9)}
    return order_stats.order_values(read("lineitem"), ["l_returnflag"], "l_partkey", places)


@query("""WITH o AS (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)
SELECT o_orderpriority, count(*) AS n, list_sort(list(v))[1 + count(*) // 2] AS upper_median, list_sort(list(v))[1 + CAST(floor(0.99 * (count(*) - 1)) AS BIGINT)] AS p99, true AS within FROM o GROUP BY 1""")
def sketched_values(read) -> DataFrame:
    o = read("orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("v"))
    places, by = {"upper_median": order_stats.upper_median, "p99": order_stats.at_share(0.99)}, ["o_orderpriority"]
    exact = order_stats.order_values(o, by, "v", places)
    halves = [order_stats.sketch(o.where(F.col("o_orderkey") % 2 == k), by, "v") for k in (0, 1)]
    near = order_stats.sketched_values(order_stats.merged(*halves), by, places).select(F.col("o_orderpriority").alias("_p"), *[F.col(p).alias(f"_{p}") for p in places])
    good = [F.abs(F.col(f"_{p}") - F.col(p)) <= 0.010001 * F.abs(F.col(p)) for p in places]
    return exact.join(near, F.col("o_orderpriority").eqNullSafe(F.col("_p"))).select("o_orderpriority", "n", *places, (good[0] & good[1]).alias("within"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS target, (['A', 'B', 'C', 'D'])[1 + p_partkey % 4] AS correct, unnest(['A', 'B', 'C', 'D']) AS o, unnest([p_type, p_brand, '', p_name]) AS t,
 unnest([p_size % 5, p_partkey % 5, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END, NULL]) AS l FROM part)
SELECT p_partkey, coalesce(string_agg(o || ':' || t, '|' ORDER BY o) FILTER (o <> correct AND l = target), '') AS target, coalesce(string_agg(o || ':' || t, '|' ORDER BY o) FILTER (o <> correct AND l <> target), '') AS other,
 coalesce(string_agg(o || ':' || t, '|' ORDER BY o) FILTER (o <> correct AND l IS NULL), '') AS unlabelled FROM p GROUP BY 1""")
def label_lists(read) -> DataFrame:
    p, i = read("part"), F.col("p_partkey") % 5
    texts = {"A": F.col("p_type"), "B": F.col("p_brand"), "C": F.lit(None).cast("string"), "D": F.col("p_name")}
    labels = {"A": F.col("p_size") % 5, "B": i, "C": F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3)}
    wide = p.select("p_partkey", i.alias("wanted"), F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("right"), *[c.alias(f"Answer{o}Text") for o, c in texts.items()], *[c.alias(f"Label{o}Id") for o, c in labels.items()])
    got = options.label_lists(wide, "Answer(.+)Text", "Label(.+)Id", F.col("right"), F.col("wanted"))
    line = lambda c: F.array_join(F.transform(c, lambda o: F.concat(o["option"], F.lit(":"), o["text"])), "|").alias(c)
    return got.select("p_partkey", line("target"), line("other"), line("unlabelled"))


@query("SELECT o_orderkey, o_totalprice, 2 AS versions FROM orders")
def published_table(read) -> DataFrame:
    o = read("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    at = _folder(o, "published")
    rules = {"key": F.col("o_orderkey").isNotNull(), "price": F.col("o_totalprice") > 0}
    unique = lambda t: checks.violations("unique", checks.not_unique(t, "o_orderkey"))
    publish.publish(o.where("o_orderstatus = 'O'"), at, rules, unique)
    publish.publish(o, at, rules, unique, least=1)
    try:
        publish.publish(o.unionAll(o), at, rules, unique)
    except checks.CheckFailed:
        return publish.current(o.sparkSession, at).select("o_orderkey", "o_totalprice", F.lit(len(publish.versions(o.sparkSession, at))).alias("versions"))
    raise AssertionError("a table with each key twice was published")


async def _upper(text: str | None) -> str | None:
    """A model's place in the catalogue."""
    return text and text.upper()


@query("SELECT conv_id || '/' || turn AS key, upper(any_value(role)) AS answer, true AS ok FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1 HAVING count(DISTINCT role) <= 1")
def asked_within(read) -> DataFrame:
    c = read("conversations").where("conv_id is not null and turn is not null").select(F.concat_ws("/", "conv_id", "turn").alias("k"), "role")
    one = c.join(c.groupBy("k").agg(F.count_distinct("role").alias("n")).where("n < 2"), "k").select("k", "role")
    return asking.asked_within(one, "k", "role", _upper, _folder(c, "asked"), 8, 64, 10).select("key", "answer", "ok")
