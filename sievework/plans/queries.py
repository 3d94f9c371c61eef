"""The library's operators over the driver tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import answers, settings
from sievework.functions import textkeys as tk
from sievework.functions.bleu import SPLITS
from sievework.operators import checks, curation, eligibility, exports, llmio, metrics, options, pairs, rewards, runs, splits, stats
from sievework.sources import corpora
from sievework.sources.work import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED = 7


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def n() -> Column:
    return F.count(F.lit(1)).alias("n")


#: Documents' duplicate key in either engine.
KEY = "regexp_replace(lower(text), '\\s+', '', 'g')"
H = "sha256(concat_ws('|', '7', {}))"


def _judged(read) -> DataFrame:
    return read("documents").join(read("labels"), "doc_id", "left")


@query(
    f"""
WITH d AS (SELECT doc_id, source, {KEY} AS k FROM documents),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM d),
r AS (SELECT m.*, l.quality, l.toxic, CASE WHEN doc_id > first THEN 'duplicate' WHEN quality IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' ELSE '' END AS reason
      FROM m LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS n, CAST(count_if(reason = '') AS BIGINT) AS eligible, CAST(count_if(reason = 'duplicate') AS BIGINT) AS duplicates,
       CAST(count_if(reason = '' AND quality = 1) AS BIGINT) AS good,
       CAST(count_if(reason = '' AND quality = 1) AS DOUBLE) / nullif(count_if(reason = ''), 0) AS good_rate
FROM r GROUP BY source"""
)
def pool_verdicts(read) -> DataFrame:
    d = read("documents").select("doc_id", "source", tk.text_key(F.col("text")).alias("k"), F.lit("").alias("reason"))
    d = curation.duplicate_reason(d.withColumn("k", F.sha2("k", 256)), ["k"], "doc_id").join(read("labels"), "doc_id", "left")
    reason = curation.first_reason([(F.col("reason") != "", "duplicate"), (F.col("quality").isNull(), "unlabelled"), (F.col("toxic") == 1, "toxic")])
    d = d.withColumn("reason", reason)
    ok = F.count_if((F.col("reason") == "") & (F.col("quality") == 1))
    eligible = F.count_if(F.col("reason") == "")
    return d.groupBy("source").agg(n(), eligible.alias("eligible"), F.count_if(F.col("reason") == "duplicate").alias("duplicates"), ok.alias("good"), metrics.ratio(ok, eligible).alias("good_rate"))


@query("SELECT doc_id, source || ':' || substr(sha256(concat_ws('␟', trim(text, ' ' || chr(10) || chr(9)), lang)), 1, 16) AS sample_id FROM documents")
def sample_id(read) -> DataFrame:
    return read("documents").select("doc_id", tk.sample_id(F.col("source"), F.col("text"), F.col("lang")).alias("sample_id"))


@query("SELECT doc_id, 'qg:' || substr(sha256(regexp_replace(lower(text), '[^\\pL\\pN]+', '', 'g')), 1, 16) AS question_key, substr(sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))), 1, 16) AS group_key FROM documents")
def question_group_key(read) -> DataFrame:
    return read("documents").select("doc_id", tk.question_key(F.col("text")).alias("question_key"), tk.group_key(F.col("text")).alias("group_key"))


@query()
def nfkc_group_key(read) -> DataFrame:
    return read("documents").select("doc_id", tk.question_key(tk.nfkc("text")).alias("question_key"))


@query(f"SELECT sha256({KEY}) AS k, min(doc_id) AS doc_id, min_by(source, doc_id) AS source, count(*) AS n_rows FROM documents GROUP BY 1")
def pool_dedupe(read) -> DataFrame:
    d = read("documents").select("doc_id", "source", F.sha2(tk.text_key(F.col("text")), 256).alias("k"))
    return curation.pool(d, ["k"], "doc_id")


@query(
    f"""WITH d AS (SELECT doc_id, n_chars < 50 AS short, {KEY} AS k FROM documents),
m AS (SELECT *, min(CASE WHEN NOT short THEN doc_id END) OVER (PARTITION BY k) AS first FROM d)
SELECT doc_id, CASE WHEN short THEN 'too_short' WHEN doc_id > first THEN 'duplicate_record_of:' || first ELSE '' END AS reason FROM m"""
)
def duplicate_reason(read) -> DataFrame:
    d = read("documents").select("doc_id", F.sha2(tk.text_key(F.col("text")), 256).alias("k"), curation.first_reason([(F.col("n_chars") < 50, "too_short")]).alias("reason"))
    return curation.duplicate_reason(d, ["k"], "doc_id").select("doc_id", "reason")


_CASCADE = """SELECT doc_id, source, CASE WHEN length(trim(text)) = 0 THEN 'missing_field:text' WHEN lang <> 'en' THEN 'language' WHEN quality IS NULL THEN 'unlabelled'
 WHEN toxic = 1 THEN 'toxic' WHEN n_chars > 4096 THEN 'too_long' ELSE '' END AS reason FROM documents LEFT JOIN labels USING (doc_id)"""


def _cascade(read) -> DataFrame:
    missing = curation.missing_reason({"text": F.col("text")})
    rules = [(missing != "", missing), (F.col("lang") != "en", "language"), (F.col("quality").isNull(), "unlabelled"), (F.col("toxic") == 1, "toxic"), (F.col("n_chars") > 4096, "too_long")]
    return _judged(read).select("doc_id", "source", curation.first_reason(rules).alias("reason"))


@query(_CASCADE)
def exclusion_cascade(read) -> DataFrame:
    return _cascade(read)


@query(f"SELECT source, reason, count(*) AS n FROM ({_CASCADE}) GROUP BY 1, 2")
def exclusion_table(read) -> DataFrame:
    return curation.exclusion_table(_cascade(read), "source")


@query("SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS labels FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def multi_label_conflict(read) -> DataFrame:
    return curation.label_conflicts(read("lineitem"), ["l_partkey"], "l_returnflag")


@query(f"""WITH d AS (SELECT DISTINCT source, {KEY} AS k FROM documents)
SELECT a.source AS dataset_a, b.source AS dataset_b, count(*) AS n_groups FROM d a JOIN d b ON a.k = b.k AND a.source < b.source GROUP BY 1, 2""")
def cross_source_overlap(read) -> DataFrame:
    return curation.overlap(read("documents").withColumn("k", F.sha2(tk.text_key(F.col("text")), 256)), "source", "k")


@query("""SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]+')) AS BIGINT) AS word_count,
 NOT (len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]+')) BETWEEN 5 AND 15) AS length_outside, regexp_matches(text, '[0-9]') AS contains_digit FROM conversations""")
def description_flags(read) -> DataFrame:
    w = F.size(tk.words(F.col("text"))).cast("long")
    return read("conversations").select("conv_id", "turn", w.alias("word_count"), (~w.between(5, 15)).alias("length_outside"), F.col("text").rlike("[0-9]").alias("contains_digit"))


@query("""WITH t AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]+'), lambda w: lower(w))) AS w FROM conversations)
SELECT a.conv_id, a.turn, coalesce(array_to_string(list_sort(list_filter(list_intersect(a.w, b.w), lambda w: len(w) > 3 AND w NOT IN ('that', 'with'))), ', '), '') AS shared
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def shared_tokens(read) -> DataFrame:
    c = read("conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", tk.shared_words(F.col("text"), F.col("before"), ["that", "with"]).alias("shared"))


@query("""SELECT o_orderkey, contains(lower(o_orderpriority), lower(trim(substr(o_orderpriority, 1 + CAST(o_orderkey % 4 AS INTEGER), 4)))) AND length(trim(substr(o_orderpriority, 1 + CAST(o_orderkey % 4 AS INTEGER), 4))) > 0 AS found FROM orders""")
def evidence_found(read) -> DataFrame:
    quote = F.substring(F.col("o_orderpriority"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(4))
    return read("orders").select("o_orderkey", tk.evidence_found(quote, F.col("o_orderpriority")).alias("found"))


@query(f"SELECT sha256({KEY}) AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, k LIMIT 25")
def repeated_text_topk(read) -> DataFrame:
    d = read("documents").groupBy(F.sha2(tk.text_key(F.col("text")), 256).alias("k")).agg(n())
    return d.where("n > 1").orderBy(F.desc("n"), "k").limit(25)  # the report's 25


@query("""WITH s AS (SELECT list_sort(list(n_chars)) AS v FROM documents)
SELECT CAST(len(v) AS BIGINT) AS n, v[1] AS min, v[1 + len(v) // 2] AS upper_median, v[1 + CAST(floor(0.99 * (len(v) - 1)) AS BIGINT)] AS p99, v[len(v)] AS max FROM s""")
def length_stats(read) -> DataFrame:
    return metrics.length_stats(read("documents"), "n_chars")


@query("""SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r
 FROM orders GROUP BY 1, 2) WHERE r = 1""")
def stratum_vote(read) -> DataFrame:
    return splits.vote(read("orders"), "o_custkey", "o_orderpriority")


def _strata(read) -> DataFrame:
    return read("documents").groupBy(F.concat_ws("/", "lang", (F.col("doc_id") % 3).cast("string")).alias("stratum")).agg(F.count(F.lit(1)).alias("available"))


@query("""WITH s AS (SELECT concat_ws('/', lang, CAST(doc_id % 3 AS VARCHAR)) AS stratum, count(*) AS available FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY available DESC, stratum) AS rank, count(*) OVER () AS k FROM s),
w AS (SELECT *, 600 // k + CASE WHEN rank <= 600 % k THEN 1 ELSE 0 END AS want FROM r),
g AS (SELECT *, least(want, available) AS got, sum(want - least(want, available)) OVER () AS deficit FROM w),
f AS (SELECT stratum, deficit, row_number() OVER (ORDER BY round, rank) AS turn FROM (SELECT *, unnest(range(1, available - got + 1)) AS round FROM g WHERE available > got)),
e AS (SELECT stratum, count(*) AS extra FROM f WHERE turn <= deficit GROUP BY 1)
SELECT stratum, available, CAST(want AS BIGINT) AS want, CAST(got + coalesce(extra, 0) AS BIGINT) AS allocated FROM g LEFT JOIN e USING (stratum)""")
def allocation_plan(read) -> DataFrame:
    return splits.allocate(_strata(read), 600)


@query(f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {H.format("doc_id")}, doc_id) AS turn FROM documents)
SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS place FROM r""")
def interleave_sample(read) -> DataFrame:
    return splits.interleave(read("documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", SEED).select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query(f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {H.format("doc_id")}, doc_id) AS turn FROM documents),
p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY turn, source, doc_id) AS place FROM r)
SELECT doc_id, CASE WHEN place <= 20 THEN 'dev' ELSE 'holdout' END AS split FROM p""")
def dev_holdout(read) -> DataFrame:
    return interleave_sample(read).select("doc_id", F.when(F.col("place") <= 20, "dev").otherwise("holdout").alias("split"))


_RANKED = f"""SELECT o_custkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n,
 row_number() OVER (PARTITION BY o_orderpriority ORDER BY {H.format("o_orderpriority, o_custkey")}, o_custkey) AS r FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)"""


def _orders(read) -> DataFrame:
    # all orders; the SQL above still has a tenth of them, so it doesn't agree (see README)
    return read("orders")


@query(f"""SELECT o_custkey, o_orderpriority, CASE WHEN r <= floor(n * 0.1 + 0.5) THEN 'test' WHEN r <= floor(n * 0.1 + 0.5) + floor(n * 0.1 + 0.5) THEN 'dev' ELSE 'train' END AS split FROM ({_RANKED})""")
def stratified_split(read) -> DataFrame:
    return splits.split_strata(_orders(read), "o_orderpriority", "o_custkey", SEED, [("test", 0.1), ("dev", 0.1)], "train")


@query(f"""WITH g AS ({_RANKED}), odd AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) % 2 AS flip FROM (SELECT DISTINCT o_orderpriority FROM g WHERE n % 2 = 1))
SELECT o_custkey, o_orderpriority, CASE WHEN (r + coalesce(flip, 1)) % 2 = 0 THEN 'A' ELSE 'B' END AS half FROM g LEFT JOIN odd USING (o_orderpriority)""")
def halves_split(read) -> DataFrame:
    return splits.halves(_orders(read), "o_orderpriority", "o_custkey", SEED)


@query(f"""WITH p AS (SELECT doc_id, lang, count(*) OVER () AS total, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY {H.format("lang, doc_id")}, doc_id) AS r
 FROM documents WHERE n_chars < 4096) SELECT doc_id, lang FROM p WHERE r <= floor(n * (50.0::DOUBLE / total) + 0.5)""")
def validation_carveout(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang", (F.col("n_chars") < 4096).alias("open"))
    return splits.carve(d, "open", "lang", "doc_id", 50, SEED)


@query("SELECT 'forced in train' AS name, true AS passed, '0 violations' AS detail UNION ALL SELECT 'one split', true, '0 violations' UNION ALL SELECT 'unique groups', true, '0 violations'")
def forced_train_leak_check(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang")
    forced = read("labels").where("toxic = 1").select("doc_id").join(d, "doc_id")
    s = splits.split_strata(d, "lang", "doc_id", SEED, [("test", 0.2)], "train", forced)
    wrong = s.join(forced.select("doc_id"), "doc_id").where("split <> 'train'")
    return checks.table(checks.violations("forced in train", wrong), checks.violations("one split", checks.in_one(s, "doc_id", "split")), checks.violations("unique groups", checks.not_unique(s, "doc_id")))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'changed' END AS kind FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def manifest_drift(read) -> DataFrame:
    now = read("documents").select("doc_id", "lang")
    saved = now.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    return curation.drift(now, saved, "doc_id", ["lang"]).select("doc_id", F.when(F.col("saved").isNull(), "missing").otherwise("changed").alias("kind"))


@query(f"SELECT event_id, user_id FROM events ORDER BY {H.format('event_id')}, event_id LIMIT 100")
def seeded_subset(read) -> DataFrame:
    return splits.subset(read("events"), "event_id", SEED, 100).select("event_id", "user_id")


@query("SELECT event_id, CAST(('0x' || substr(sha256(concat_ws('|', '7', user_id, event_id)), 1, 8)) AS BIGINT) AS seed FROM events")
def rollout_seed(read) -> DataFrame:
    return read("events").select("event_id", tk.hash_int(F.concat_ws("|", F.lit("7"), "user_id", "event_id")).alias("seed"))


def _negatives(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang", "source", (F.col("doc_id") % 50).alias("g"))
    return pairs.donors(d, ["lang"], "doc_id", "source", "g", SEED)


@query(f"""WITH d AS (SELECT doc_id, lang, source, doc_id % 50 AS g, row_number() OVER (PARTITION BY lang ORDER BY {H.format("doc_id")}, doc_id) AS r FROM documents),
a AS (SELECT x.lang, x.doc_id AS anchor, min_by(y.doc_id, y.r) AS donor FROM d x JOIN d y ON x.lang = y.lang AND y.r > x.r AND y.r <= x.r + 8 AND x.source <> y.source AND x.g <> y.g GROUP BY 1, 2),
b AS (SELECT x.lang, x.doc_id AS anchor, min_by(y.doc_id, y.r) AS donor FROM d x JOIN d y ON x.lang = y.lang AND x.source <> y.source AND x.g <> y.g WHERE x.doc_id NOT IN (SELECT anchor FROM a) GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def negative_pairs(read) -> DataFrame:
    return _negatives(read)


@query("""SELECT lang, source, count(*) AS positives, count(*) AS negatives FROM documents GROUP BY 1, 2""")
def negative_audit(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang", "source")
    neg = _negatives(read).select(F.col("anchor").alias("doc_id"))
    rows = d.withColumn("target", F.lit("aligned")).unionByName(d.join(neg, "doc_id").withColumn("target", F.lit("not_aligned")))
    return pairs.audit(rows, "lang", "source", "target")


@query("""SELECT l_orderkey, l_linenumber, type FROM lineitem, (VALUES ('A', false), ('N', false), ('R', true), ('U', true)) t(type, unit)
WHERE l_returnflag <> type AND (NOT unit OR (CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 = 1 END) IS NOT DISTINCT FROM true)""")
def type_candidates(read) -> DataFrame:
    li = read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3 == 1).alias("eligible"))
    types = li.sparkSession.createDataFrame([("A", False), ("N", False), ("R", True), ("U", True)], "type string, unit boolean")
    return pairs.candidates(li, types, "l_returnflag", "unit", "eligible").select("l_orderkey", "l_linenumber", "type")


_PRED = """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CASE WHEN l_linenumber % 2 = 0 THEN 'aligned' ELSE 'not_aligned' END AS target,
 CASE WHEN l_partkey % 10 = 0 THEN 'invalid' WHEN l_partkey % 3 = 0 THEN 'aligned' ELSE 'not_aligned' END AS prediction FROM lineitem"""
_COUNTS = """count(*) AS n, count_if(target = 'aligned' AND prediction = 'aligned') AS tp, count_if(target = 'not_aligned' AND prediction = 'aligned') AS fp,
 count_if(target = 'aligned' AND prediction <> 'aligned') AS fn, count_if(target = 'not_aligned' AND prediction = 'not_aligned') AS tn,
 count_if(target = 'aligned' AND prediction = 'not_aligned') AS neg_fp, count_if(target = 'not_aligned' AND prediction <> 'not_aligned') AS neg_fn, count_if(prediction = 'invalid') AS invalid"""


def _predictions(read) -> DataFrame:
    p = F.when(F.col("l_partkey") % 10 == 0, "invalid").when(F.col("l_partkey") % 3 == 0, "aligned").otherwise("not_aligned")
    t = F.when(F.col("l_linenumber") % 2 == 0, "aligned").otherwise("not_aligned")
    return read("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", t.alias("target"), p.alias("prediction"), (t == p).alias("correct"))


@query(f"""WITH c AS (SELECT {_COUNTS} FROM ({_PRED})), r AS (SELECT *, CAST(tp + tn AS DOUBLE) / n AS accuracy, CAST(tp AS DOUBLE) / (tp + fp) AS precision_pos, CAST(tp AS DOUBLE) / (tp + fn) AS recall_pos,
 CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) AS f1_pos, CAST(2 * tn AS DOUBLE) / (2 * tn + neg_fp + neg_fn) AS f1_neg FROM c)
SELECT *, (f1_pos + f1_neg) / 2 AS macro_f1, CAST(fp AS DOUBLE) / (n - tp - fn) AS negative_acceptance, CAST(invalid AS DOUBLE) / n AS invalid_rate FROM r""")
def confusion_metrics(read) -> DataFrame:
    return metrics.rates(_predictions(read).agg(*metrics.confusion()))


@query(f"""SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_linestatus) = 0 THEN 'l_linestatus' ELSE 'all' END AS facet,
 coalesce(CASE WHEN grouping(l_returnflag) = 0 THEN l_returnflag WHEN grouping(l_linestatus) = 0 THEN l_linestatus END, '') AS value, {_COUNTS}
FROM ({_PRED}) GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus)) HAVING count(*) >= 10""")
def metric_breakdown(read) -> DataFrame:
    return metrics.breakdown(_predictions(read), ["l_returnflag", "l_linestatus"], 10, *metrics.confusion())


@query(f"""WITH a AS (SELECT l_orderkey, count(DISTINCT target) AS k, bool_and(target = prediction) AS ok FROM ({_PRED}) GROUP BY 1)
SELECT count(*) AS pairs, CAST(coalesce(sum(CASE WHEN ok THEN 1 ELSE 0 END), 0) AS BIGINT) AS "right", CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS pair_accuracy FROM a WHERE k = 2""")
def pair_accuracy(read) -> DataFrame:
    return metrics.pair_accuracy(_predictions(read), "l_orderkey", "target", "correct")


_ROLL = """SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS condition, value,
 CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'correct' ELSE 'incorrect' END AS verdict, event_type = 'click' AS accepted FROM events"""


def _rollouts(read) -> DataFrame:
    e = F.col("event_type")
    verdict = F.when(e == "error", F.lit(None)).when(e == "purchase", "correct").otherwise("incorrect")
    k = F.get_json_object("props", "$.k").cast("long")
    return read("events").select("event_id", "user_id", (k % 5).alias("condition"), "value", verdict.alias("verdict"), (e == "click").alias("accepted"), k.alias("k"))


_GROUPS = f"""SELECT user_id, CAST(sum(rollouts) AS BIGINT) AS rollouts, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(incorrect) AS BIGINT) AS incorrect, CAST(sum("null") AS BIGINT) AS "null", CAST(sum(success) AS BIGINT) AS success,
 count(*) AS conditions, count_if(success = 0) AS zero_success_conditions FROM (SELECT user_id, condition, count(*) AS rollouts, count_if(verdict = 'correct') AS correct, count_if(verdict = 'incorrect') AS incorrect,
 count_if(verdict IS NULL) AS "null", count_if(verdict = 'incorrect' AND accepted) AS success FROM ({_ROLL}) GROUP BY 1, 2) GROUP BY 1"""


@query(_GROUPS)
def group_counts(read) -> DataFrame:
    return metrics.group_counts(_rollouts(read), "user_id", "condition")


@query(f"""SELECT CAST(sum(incorrect) AS DOUBLE) / sum(rollouts) AS wrong_rate, CAST(sum(correct) AS DOUBLE) / sum(rollouts) AS correct_rate, CAST(sum("null") AS DOUBLE) / sum(rollouts) AS null_rate,
 CAST(sum(success) AS DOUBLE) / sum(rollouts) AS joint_success, CAST(sum(success) AS DOUBLE) / sum(incorrect) AS accept_given_wrong, CAST(sum(zero_success_conditions) AS DOUBLE) / sum(conditions) AS zero_success_condition_rate FROM ({_GROUPS})""")
def ratios(read) -> DataFrame:
    return metrics.ratio_table(metrics.group_counts(_rollouts(read), "user_id", "condition"))


@query(f"""WITH t AS (SELECT condition, count_if(verdict = 'incorrect' AND accepted) AS a, count(*) AS b FROM ({_ROLL}) GROUP BY 1)
SELECT count(*) AS types, round(avg(CAST(a AS DOUBLE) / b), 9) AS macro FROM t""")
def macro_over_types(read) -> DataFrame:
    t = _rollouts(read).groupBy("condition").agg(metrics.ratio(F.count_if((F.col("verdict") == "incorrect") & F.col("accepted")), F.count(F.lit(1))).alias("r"))
    return t.agg(F.count(F.lit(1)).alias("types"), F.round(F.avg("r"), 9).alias("macro"))


@query("""WITH c AS (SELECT conv_id, count(DISTINCT lower(regexp_replace(text, '\\s+', '', 'g'))) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
SELECT count(*) AS conditions, CAST(sum(n) AS BIGINT) AS answers, CAST(sum(n) AS DOUBLE) / count(*) AS mean FROM c""")
def unique_solutions(read) -> DataFrame:
    c = read("conversations").select("conv_id", tk.text_key(F.col("text")).alias("a"), (F.col("role") == "assistant").alias("accepted"))
    return metrics.unique_successes(c, "conv_id", "a")


@query("SELECT count(*) AS both_judged, count_if(quality <> toxic) AS disagree, CAST(count_if(quality <> toxic) AS DOUBLE) / count(*) AS disagreement FROM labels")
def judge_disagreement(read) -> DataFrame:
    return metrics.agreement(read("labels"), "quality", "toxic")


@query(f"""SELECT event_id, CASE WHEN verdict IS NULL THEN -0.75 WHEN verdict = 'correct' THEN -0.5 WHEN accepted THEN 1.0 ELSE 0.0 END::DOUBLE AS main,
 value >= 20 AND event_id % 3 <> 0 AS truncated, value < 20 AND event_id % 3 <> 0 AS anomaly,
 (CASE WHEN value >= 20 AND event_id % 3 <> 0 THEN -0.25 ELSE 0.0 END)::DOUBLE AS trunc,
 (CASE WHEN verdict IS NULL THEN -0.75 WHEN verdict = 'correct' THEN -0.5 WHEN accepted THEN 1.0 ELSE 0.0 END + CASE WHEN value >= 20 AND event_id % 3 <> 0 THEN -0.25 ELSE 0.0 END)::DOUBLE AS total FROM ({_ROLL})""")
def total_reward(read) -> DataFrame:
    r = _rollouts(read)
    labels = F.when(F.col("accepted"), F.array(F.lit("aligned"), F.lit("aligned"))).otherwise(F.array(F.lit("aligned"), F.lit("not_aligned")))
    r = r.select("event_id", rewards.main_reward(rewards.known_verdict(F.col("verdict")), labels, 0.5).alias("main"), *rewards.truncation(F.col("value"), F.col("event_id") % 3 == 0, 20, 0.25))
    return r.withColumn("total", rewards.total(F.col("main"), F.lit(None).cast("double"), F.col("trunc"), 1.0))


@query(f"""SELECT user_id, coalesce(list_sort(list(event_id) FILTER (verdict = 'incorrect' AND accepted)), []) AS accepted_positions, count_if(verdict = 'incorrect' AND accepted) AS k FROM ({_ROLL}) GROUP BY 1""")
def accepted_set(read) -> DataFrame:
    return rewards.accepted_groups(_rollouts(read), "user_id", "event_id")


@query(f"""WITH c AS (SELECT event_id, CASE WHEN verdict IS NULL THEN 'null' WHEN verdict = 'correct' THEN 'correct' WHEN event_id % 4 = 0 THEN 'distractor' WHEN accepted THEN 'verifier_pass' ELSE 'incorrect_rejected' END AS reward_case FROM ({_ROLL}))
SELECT *, CASE reward_case WHEN 'null' THEN -0.75 WHEN 'correct' THEN -0.5 WHEN 'distractor' THEN 1.0 WHEN 'verifier_pass' THEN 0.5 ELSE 0.0 END::DOUBLE AS main FROM c""")
def distractor_reward(read) -> DataFrame:
    r = _rollouts(read)
    case = rewards.distractor_case(F.col("verdict"), F.when(F.col("event_id") % 4 == 0, "B"), F.when(F.col("accepted"), F.array(F.lit("aligned"))).otherwise(F.array().cast("array<string>")))
    return r.select("event_id", case.alias("reward_case")).withColumn("main", rewards.distractor_reward(F.col("reward_case"), 0.5))


@query(f"""WITH c AS (SELECT event_id, CASE WHEN verdict IS NULL THEN 'null' WHEN k % 10 = 7 THEN 'literal_correct' WHEN k % 10 IN (1, 2) OR accepted THEN 'distractor' ELSE 'no_match' END AS reward_case
 FROM ({_ROLL}) JOIN (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) USING (event_id))
SELECT *, CASE reward_case WHEN 'distractor' THEN 1.0 ELSE -0.75 END::DOUBLE AS main FROM c""")
def verifiable_reward(read) -> DataFrame:
    r = _rollouts(read)
    answer = F.when(F.col("verdict").isNull(), F.lit(None)).otherwise(F.concat(F.lit("$ "), (F.col("k") % 10).cast("string"), F.lit("$")))
    case = rewards.verifiable_case(answer, F.lit("7"), F.array(F.lit("1"), F.lit("2 ")), F.when(F.col("accepted"), "C"))
    return r.select("event_id", case.alias("reward_case")).withColumn("main", rewards.verifiable_reward(F.col("reward_case")))


_SCHED = f"""WITH g AS (SELECT user_id, event_id, {H.format("user_id, event_id")} AS h FROM events WHERE event_type = 'click'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS k FROM g),
j AS (SELECT x.user_id, x.event_id AS x, y.event_id AS y, (2 * (y.p - x.p) < x.k) OR (2 * (y.p - x.p) = x.k AND x.p % 2 = 0) AS f FROM r x JOIN r y ON x.user_id = y.user_id AND x.p < y.p),
s AS (SELECT user_id, CASE WHEN f THEN x ELSE y END AS a, CASE WHEN f THEN y ELSE x END AS b FROM j)"""


def _schedule(read) -> DataFrame:
    # the members that accepted_set lists; the SQL above still has a fifth of them, so it doesn't agree (see README)
    m = _rollouts(read).where("verdict = 'incorrect' AND accepted").select("user_id", "event_id")
    return rewards.pair_schedule(m, "user_id", "event_id", SEED)


@query(_SCHED + " SELECT * FROM s")
def pair_schedule(read) -> DataFrame:
    return _schedule(read)


@query(_SCHED + """, w AS (SELECT *, CASE (a + b) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS winner FROM s),
u AS (SELECT user_id, a AS item, CASE winner WHEN 'A' THEN 2 WHEN 'tie' THEN 1 ELSE 0 END AS v FROM w UNION ALL SELECT user_id, b, CASE winner WHEN 'B' THEN 2 WHEN 'tie' THEN 1 ELSE 0 END FROM w)
SELECT user_id, item, CAST(sum(v) AS DOUBLE) / (2 * count(*)) AS score FROM u GROUP BY 1, 2""")
def win_scores(read) -> DataFrame:
    c = (F.col("a") + F.col("b")) % 3
    return rewards.win_scores(_schedule(read).withColumn("winner", F.when(c == 0, "A").when(c == 1, "B").otherwise("tie")), "user_id")


_TOKENS = """replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '\\s+$', ''), '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"""
for _find, _put in SPLITS:
    _TOKENS = f"regexp_replace({_TOKENS if _find is not SPLITS[0][0] else chr(39) + ' ' + chr(39) + ' || ' + _TOKENS + ' || ' + chr(39) + ' ' + chr(39)}, '{_find}', '{_put}', 'g')"


@query(f"""WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' AS void, list_filter(string_split_regex({_TOKENS}, '\\s+'), lambda x: x <> '') AS tok FROM conversations),
g AS (SELECT conv_id, r, n, gram, count(*) AS c FROM (SELECT conv_id, r, n, unnest(list_transform(range(1, len(tok) - n + 2), lambda i: array_to_string(tok[i:i + n - 1], ' '))) AS gram FROM t, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL),
m AS (SELECT a.r AS x, b.r AS y, a.n, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.n = b.n AND a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
p AS (SELECT a.r AS x, b.r AS y, len(a.tok) AS k, len(b.tok) AS l FROM t a JOIN t b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.r <> b.r),
q AS (SELECT x, y, k, l, n, k - n + 1 AS total, coalesce(m, 0) AS m FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS n) LEFT JOIN m USING (x, y, n) WHERE n <= k),
z AS (SELECT *, sum(CASE WHEN m = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY x, y ORDER BY n) AS zeros FROM q),
s AS (SELECT x, y, CASE WHEN max(m) = 0 THEN 0 ELSE exp(avg(ln(CASE WHEN m > 0 THEN m / total ELSE 1 / (2.0 ** zeros * total) END)) + CASE WHEN any_value(k) > any_value(l) THEN 0 ELSE 1 - any_value(l) / any_value(k) END) END AS bleu FROM z GROUP BY 1, 2)
SELECT conv_id, turn, round(CASE WHEN any_value(void) THEN 0 ELSE least(1, greatest(0, 1 - coalesce(max(bleu), 0))) END, 9) AS diversity FROM t JOIN p ON p.x = t.r LEFT JOIN s ON s.x = p.x AND s.y = p.y GROUP BY r, conv_id, turn""")
def bleu_diversity(read) -> DataFrame:
    return rewards.bleu_diversity(read("conversations"), "conv_id", "turn", "text").withColumn("diversity", F.round("diversity", 9))


_EDGE = """WITH c AS (SELECT o_custkey % 200 AS g, o_orderpriority AS model, count_if(l_returnflag = 'R') AS a, count(*) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
g AS (SELECT g, row_number() OVER (ORDER BY sha256(concat_ws('|', '7', g)), g) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM c)),
d AS (SELECT replicate, CAST(('0x' || substr(sha256(concat_ws('|', '7', replicate, place)), 1, 8)) AS BIGINT) % n AS place FROM g, range(0, 50) r(replicate)),
t AS (SELECT replicate, g, count(*) AS times FROM d JOIN g USING (place) GROUP BY 1, 2),
v AS (SELECT model, replicate, CAST(sum(a * times) AS DOUBLE) / sum(b * times) AS value FROM c JOIN t USING (g) GROUP BY 1, 2)"""


def _replicates(read) -> DataFrame:
    o = read("orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("g"), F.col("o_orderpriority").alias("model"))
    c = read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("g", "model").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count(F.lit(1)).alias("b"))
    return stats.replicate_ratios(stored(c, "clusters"), "g", ["model"], "a", "b", 50, SEED)


@query(_EDGE + " SELECT model, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(*) AS replicates FROM v GROUP BY 1")
def bootstrap_ci(read) -> DataFrame:
    return stats.interval(_replicates(read), ["model"]).select("model", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "replicates")


@query(_EDGE + """, p AS (SELECT v.model, v.replicate, v.value - b.value AS value FROM v JOIN v b ON v.replicate = b.replicate AND b.model = '1-URGENT' WHERE v.model <> '1-URGENT')
SELECT model, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(*) AS replicates FROM p GROUP BY 1""")
def paired_bootstrap(read) -> DataFrame:
    p = stats.paired(_replicates(read), "model", "1-URGENT")
    return stats.interval(p, ["model"]).select("model", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), "replicates")


_SNAP = """SELECT CAST(event_id % 12 AS BIGINT) AS epoch, CASE WHEN event_id % 12 = 3 THEN NULL ELSE CAST(count_if(event_type = 'purchase') AS DOUBLE) / count(*) END AS score, count_if(event_type = 'error') AS errors FROM events GROUP BY 1, event_id % 12"""


def _snapshots(read) -> DataFrame:
    g = read("events").groupBy((F.col("event_id") % 12).alias("epoch")).agg(metrics.ratio(F.count_if(F.col("event_type") == "purchase"), F.count(F.lit(1))).alias("score"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.withColumn("score", F.when(F.col("epoch") != 3, F.col("score")))


@query(f"SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, errors ASC NULLS LAST, epoch) AS rank FROM ({_SNAP})")
def checkpoint_ranking(read) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(*stats.checkpoint_order([("score", "max"), ("errors", "min")], "epoch"))
    return _snapshots(read).withColumn("rank", F.row_number().over(w).cast("long"))


@query(f"SELECT epoch, score FROM ({_SNAP}) ORDER BY score DESC NULLS LAST, epoch LIMIT 1")
def best_snapshot(read) -> DataFrame:
    return _snapshots(read).orderBy(*stats.checkpoint_order([("score", "max")], "epoch")).limit(1).select("epoch", "score")


@query("""SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase
FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = 3""")
def n_way_alignment(read) -> DataFrame:
    names = ["click", "view", "purchase"]
    return stats.aligned_runs(read("events").where(F.col("event_type").isin(names)), "event_type", "user_id", "value", names)


@query("""SELECT c.user_id, c.value AS value, coalesce(o.best, 'not in the other run') AS other FROM (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1) c
LEFT JOIN (SELECT user_id, 'yes' AS best FROM events WHERE event_type = 'purchase' AND value > 60 GROUP BY 1) o USING (user_id)""")
def run_compare(read) -> DataFrame:
    a = read("events").where("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("value"))
    b = read("events").where("event_type = 'purchase' AND value > 60").select("user_id", F.lit("yes").alias("other")).distinct()
    return curation.with_fallback(a, b, "user_id", "other", "not in the other run")


@query("""WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rank FROM events)
SELECT a.user_id, CAST(a.rank AS INTEGER) AS rank, a.value AS a, b.value AS b FROM r a JOIN r b ON a.user_id = b.user_id AND a.rank = b.rank WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def rank_zip_pairs(read) -> DataFrame:
    e = read("events")
    return stats.rank_zip(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "event_id", "value")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'empty_response' WHEN event_id % 5 = 1 THEN 'json_parse_error' WHEN event_id % 5 = 2 THEN 'schema_invalid' ELSE 'ok' END AS processing_status,
 event_id % 5 = 4 AS repaired, CASE WHEN event_id % 5 >= 3 THEN event_type END AS description FROM events""")
def json_validate(read) -> DataFrame:
    k = F.col("event_id") % 5
    good = F.concat(F.lit('{"description":"'), "event_type", F.lit('","evidence_quote":"x","status":"ok"}'))
    text = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat("props", F.lit("}"))).when(k == 2, F.col("props")).when(k == 3, good).otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    r = llmio.parse_answers(read("events").select("event_id", text.alias("answer")), "answer", ["description", "evidence_quote", "status"], ["ok", "ambiguous", "label_conflict"])
    return r.select("event_id", "processing_status", "repaired", "description")


_REQ = """SELECT sha256('{"event":"' || event_type || '","user":"' || user_id || '"}') AS request_key, event_id, event_type, user_id FROM events"""


def _requests(read) -> DataFrame:
    return read("events").withColumn("request_key", llmio.request_key(user=F.col("user_id").cast("string"), event=F.col("event_type")))


@query(f"SELECT event_id, request_key FROM ({_REQ})")
def request_key(read) -> DataFrame:
    return _requests(read).select("event_id", "request_key")


@query(f"""SELECT DISTINCT request_key FROM ({_REQ}) WHERE request_key NOT IN (SELECT request_key FROM ({_REQ}) WHERE event_id % 50 = 0 AND event_id % 100 <> 0)""")
def resume_pending(read) -> DataFrame:
    r = _requests(read)
    done = r.where("event_id % 50 = 0").withColumn("processing_status", F.when(F.col("event_id") % 100 == 0, "failed").otherwise("ok"))
    return llmio.pending(r.select("request_key"), done.select("request_key", "processing_status"))


@query("""WITH a AS (SELECT event_id % 10 AS k, event_id // 10 AS i, event_type FROM events), o AS (SELECT unnest(range(-4, 3)) AS "offset")
SELECT CAST("offset" AS INTEGER) AS "offset", count(*) AS n, count_if(x.event_type = y.event_type) AS hits, CAST(count_if(x.event_type = y.event_type) AS DOUBLE) / count(*) AS rate
FROM a x, o JOIN a y ON x.k = y.k AND y.i = x.i + "offset" GROUP BY 1""")
def offset_audit(read) -> DataFrame:
    e = read("events").select((F.col("event_id") % 10).alias("k"), F.floor(F.col("event_id") / 10).alias("i"), F.col("event_type"))
    return stats.offset_rates(e.withColumnRenamed("event_type", "x"), e, "k", "i", F.col("x") == F.col("event_type"), range(-4, 3))


@query("""SELECT p_partkey, option, CASE WHEN text = p_type THEN 'target' WHEN text = '' THEN 'unlabelled' ELSE 'other' END AS kind FROM (
 SELECT p_partkey, p_type, unnest(['A', 'B', 'C', 'D']) AS option, unnest([p_type, p_brand, '', p_name]) AS text FROM part)""")
def distractor_classify(read) -> DataFrame:
    said = {"A": F.col("p_type"), "B": F.col("p_brand"), "C": F.lit(""), "D": F.col("p_name")}
    p = read("part").select("p_partkey", "p_type", *[c.alias(f"{part}{o}") for o, c in said.items() for part in ("text", "label")])
    return options.option_rows(p, ["p_partkey", "p_type"], "text(.)", "label(.)").select("p_partkey", "option", options.kind_of(F.col("label"), F.col("p_type")).alias("kind"))


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat, count(*) AS turns FROM conversations GROUP BY 1""")
def chat_messages(read) -> DataFrame:
    m = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return read("conversations").groupBy("conv_id").agg(F.array_join(F.transform(m, lambda x: x["line"]), "\n").alias("chat"), n().alias("turns"))


@query("""SELECT conv_id, turn, 'As ' || role || ' in ' || conv_id || ': ' || text || ' {role}' AS prompt FROM conversations""")
def template_render(read) -> DataFrame:
    values = {"role": F.col("role"), "conv": F.col("conv_id"), "text": F.concat("text", F.lit(" {role}"))}
    return read("conversations").select("conv_id", "turn", tk.render("As {role} in {conv}: {text}", values).alias("prompt"))


@query("""SELECT s.lang AS anchor, d.lang AS donor, count(*) AS n FROM documents s JOIN documents d ON d.doc_id = s.doc_id + 1 GROUP BY 1, 2""")
def anchor_donor_matrix(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("donor"))
    return d.join(nxt, "doc_id").groupBy(F.col("lang").alias("anchor"), "donor").agg(n())


@query()
def balanced_assignment(read) -> DataFrame:
    e = read("events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("b"), F.lit("c"))).alias("own"))
    return splits.balanced_exact(e, "event_id", "own", SEED, "event_type")


@query(f"SELECT event_id, event_type, (['a', 'b', 'c'])[1 + CAST((row_number() OVER (PARTITION BY event_type ORDER BY {H.format('event_id')}, event_id) - 1) % 3 AS INTEGER)] AS option FROM events")
def balanced_assignment_hashed(read) -> DataFrame:
    return splits.balanced(read("events").select("event_id", "event_type"), "event_id", ["a", "b", "c"], SEED, "event_type")


@query("""SELECT a.vec_id, round(1 - max(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS diversity FROM embeddings a JOIN embeddings b
 ON a.label = b.label AND a.vec_id // 100 = b.vec_id // 100 AND a.vec_id <> b.vec_id GROUP BY 1""")
def embedding_diversity(read) -> DataFrame:
    e = read("embeddings").select("vec_id", "label", F.floor(F.col("vec_id") / 100).alias("g"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    a, b = e.alias("a"), e.alias("b")
    # groups (label and hundred) are of bounded size
    j = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.g") == F.col("b.g")) & (F.col("a.vec_id") != F.col("b.vec_id")))
    cos = dot(F.col("a.v"), F.col("b.v")) / (F.sqrt(dot(F.col("a.v"), F.col("a.v"))) * F.sqrt(dot(F.col("b.v"), F.col("b.v"))))
    return j.groupBy(F.col("a.vec_id").alias("vec_id")).agg(F.round(1 - F.max(cos), 6).alias("diversity"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) GROUP BY 1")
def length_limited_anchors(read) -> DataFrame:
    return curation.drop_long_anchors(read("lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", "l_quantity", 48).groupBy("l_orderkey").agg(n())


@query(f"""WITH h AS (SELECT doc_id, lang, n_chars % 100 AS g, {H.format("doc_id")} AS h FROM documents),
f AS (SELECT lang, g, min(h) AS h, min_by(doc_id, h) AS doc_id FROM h GROUP BY 1, 2),
a AS (SELECT * FROM f WHERE lang = 'es' ORDER BY h LIMIT 30), b AS (SELECT * FROM f WHERE lang = 'de' AND g NOT IN (SELECT g FROM a) ORDER BY h LIMIT 30)
SELECT lang, g, doc_id FROM a UNION ALL SELECT lang, g, doc_id FROM b""")
def sample_once_per_group(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang", (F.col("n_chars") % 100).alias("g"))
    return splits.sample_once(d, [("es", 30), ("de", 30)], "lang", "g", "doc_id", SEED).select("lang", "g", "doc_id")


_RUNS = f"""SELECT *, verdict = 'incorrect' AND accepted IS TRUE AS in_g, CASE WHEN verdict = 'incorrect' THEN event_id % 4 END AS shape, CAST(user_id % 4 AS BIGINT) AS k,
 event_id % 7 = 0 AS cached, event_id % 3 + 1 AS attempts, event_id % 11 = 0 AS truncated, event_id % 13 = 0 AS anomaly FROM ({_ROLL})"""


def _results(read) -> DataFrame:
    r, i = _rollouts(read).drop("k"), F.col("event_id")
    aligned, other, bad = F.lit("aligned"), F.lit("not_aligned"), F.lit("invalid")
    shapes = [F.array(aligned, aligned), F.array(aligned, other), F.array(bad, bad), F.array(other, other)]
    labels = F.when(F.col("verdict") == "incorrect", F.element_at(F.array(*shapes), (i % 4 + 1).cast("int")))
    in_g = F.coalesce((F.col("verdict") == "incorrect") & F.col("accepted"), F.lit(False))
    flags = [(i % m == 0).alias(c) for m, c in ((7, "cached"), (11, "truncated"), (13, "anomaly"))]
    return r.select("*", in_g.alias("in_g"), labels.alias("labels"), (F.col("user_id") % 4).alias("k"), *flags, (i % 3 + 1).alias("attempts"), (i % 8).alias("latency_s"), (i % 5).alias("aux"), (i % 4).alias("total"))


@query(f"""WITH r AS ({_RUNS}) SELECT condition, count(*) AS n, CAST(count_if(verdict IS NULL) AS DOUBLE) / count(*) AS null_rate, CAST(count_if(verdict = 'correct') AS DOUBLE) / count(*) AS correct_rate,
 CAST(count_if(verdict = 'incorrect') AS DOUBLE) / count(*) AS incorrect_rate, coalesce(CAST(count_if(verdict = 'incorrect') AS DOUBLE) / nullif(count(verdict), 0), 0) AS incorrect_rate_judgeable,
 CAST(count_if(cached) AS DOUBLE) / count(*) AS cache_hit_rate, coalesce(CAST(sum(attempts - 1) FILTER (NOT cached) AS DOUBLE) / nullif(count_if(NOT cached), 0), 0) AS retry_rate,
 coalesce(CAST(sum(event_id % 8) FILTER (NOT cached) AS DOUBLE) / nullif(count_if(NOT cached), 0), 0) AS latency_s,
 coalesce(CAST(count_if(shape = 0) AS DOUBLE) / nullif(count(shape), 0), 0) AS accept_rate_incorrect, coalesce(CAST(2 * count_if(shape = 2) AS DOUBLE) / nullif(2 * count(shape), 0), 0) AS invalid_sample_rate,
 coalesce(CAST(count_if(shape = 1) AS DOUBLE) / nullif(count(shape), 0), 0) AS sample_disagreement_rate, CAST(count_if(in_g) AS DOUBLE) / count(*) AS success_rate,
 CAST(count_if(in_g AND k >= 2) AS DOUBLE) / count(*) AS aux_active_rate, coalesce(CAST(sum(event_id % 5) FILTER (in_g AND k >= 2) AS DOUBLE) / nullif(count_if(in_g AND k >= 2), 0), 0) AS aux_mean_active,
 CAST(count_if(truncated) AS DOUBLE) / count(*) AS truncation_rate, count_if(anomaly) AS anomalies, CAST(sum(event_id % 4) AS DOUBLE) / count(*) AS total_mean FROM r GROUP BY condition""")
def step_metrics(read) -> DataFrame:
    return runs.step_metrics(_results(read), ("condition",))


@query(f"""SELECT CAST(sum(k) AS DOUBLE) / count(*) AS k_mean, CAST(count_if(k >= 2) AS DOUBLE) / count(*) AS k_ge2_rate, CAST(count_if(k = 0) AS DOUBLE) / count(*) AS k0_rate
 FROM (SELECT user_id, count_if(verdict = 'incorrect' AND accepted) AS k FROM ({_ROLL}) GROUP BY 1)""")
def group_size_rates(read) -> DataFrame:
    return runs.group_sizes(rewards.accepted_groups(_rollouts(read), "user_id", "event_id"))


@query(f"""WITH c AS (SELECT CASE WHEN verdict IS NULL THEN 'null' WHEN verdict = 'correct' THEN 'correct' WHEN event_id % 4 = 0 THEN 'distractor' WHEN accepted THEN 'verifier_pass' ELSE 'incorrect_rejected' END AS r FROM ({_ROLL}))
SELECT count(*) AS n, CAST(count_if(r = 'null') AS DOUBLE) / count(*) AS null_rate, CAST(count_if(r = 'correct') AS DOUBLE) / count(*) AS correct_rate, CAST(count_if(r = 'distractor') AS DOUBLE) / count(*) AS distractor_rate,
 CAST(count_if(r = 'verifier_pass') AS DOUBLE) / count(*) AS verifier_pass_rate, CAST(count_if(r = 'incorrect_rejected') AS DOUBLE) / count(*) AS incorrect_rejected_rate FROM c""")
def reward_case_rates(read) -> DataFrame:
    return runs.case_rates(distractor_reward(read), "reward_case", ["null", "correct", "distractor", "verifier_pass", "incorrect_rejected"])


@query(f"""WITH r AS (SELECT shape, condition % 2 = 0 AS positive, CASE WHEN k = 1 THEN 'same_stage' WHEN k = 2 THEN 'different_stage' END AS kind FROM ({_RUNS}) WHERE verdict = 'incorrect')
SELECT CAST(count_if(positive AND shape <> 0) AS DOUBLE) / count_if(positive) AS false_rejection, CAST(count_if(NOT positive AND shape = 0) AS DOUBLE) / count_if(NOT positive) AS false_acceptance,
 CAST(2 * count_if(shape = 2) AS DOUBLE) / (2 * count(*)) AS invalid_sample_rate, CAST(count_if(shape = 1) AS DOUBLE) / count(*) AS sample_disagreement_rate,
 CAST(count_if(NOT positive AND kind = 'same_stage' AND shape = 0) AS DOUBLE) / nullif(count_if(NOT positive AND kind = 'same_stage'), 0) AS false_acceptance_same_stage,
 CAST(count_if(NOT positive AND kind = 'different_stage' AND shape = 0) AS DOUBLE) / nullif(count_if(NOT positive AND kind = 'different_stage'), 0) AS false_acceptance_different_stage FROM r""")
def served_judge_check(read) -> DataFrame:
    r = _results(read).where("verdict = 'incorrect'")
    kind = F.when(F.col("k") == 1, "same_stage").when(F.col("k") == 2, "different_stage")
    r = r.select("labels", F.when(F.col("condition") % 2 == 0, "aligned").otherwise("not_aligned").alias("target"), kind.alias("negative_kind"))
    return runs.judge_rates(r, ["same_stage", "different_stage"])


@query("SELECT coalesce(CAST(sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT), 0) AS k, CAST(0 AS BIGINT) AS missing FROM events")
def usage_totals(read) -> DataFrame:
    u = F.struct(F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))
    return runs.usage_totals(read("events").select(u.alias("usage")), "usage.k", "usage.missing")


@query("SELECT lang, count(*) AS requests, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text)) // 4 AS BIGINT) AS approx_tokens, CAST(sum(length(text)) // 4 AS DOUBLE) * 0.25 / 1e6 AS cost FROM documents GROUP BY 1")
def cost_estimate(read) -> DataFrame:
    return runs.cost_estimate(read("documents"), "text", 0.25, ("lang",))


@query("""SELECT lang, 'source' AS facet, source AS value, count(*) AS n FROM documents GROUP BY 1, 3 UNION ALL
SELECT lang, 'long', CASE WHEN n_chars > 4096 THEN 'true' ELSE 'false' END, count(*) FROM documents GROUP BY 1, 3""")
def facet_histogram(read) -> DataFrame:
    d = read("documents").select("lang", F.create_map(F.lit("source"), "source", F.lit("long"), (F.col("n_chars") > 4096).cast("string")).alias("annotations"))
    return runs.facet_counts(d, "annotations", "lang")


@query(f"SELECT count(*) AS donors, max(n) AS most_uses FROM (SELECT donor, count(*) AS n FROM ({ORACLES['negative_pairs']}) GROUP BY 1)")
def donor_reuse(read) -> DataFrame:
    return runs.donor_reuse(_negatives(read))


@query("""WITH q AS (SELECT o_orderstatus AS split, count(*) AS questions, CAST(sum(o_custkey % 5) AS BIGINT) AS total FROM orders GROUP BY 1),
s AS (SELECT split, questions, 'balanced k=' || k AS scenario, questions * k AS conditions FROM q, (VALUES (1), (2), (4)) t(k) UNION ALL SELECT split, questions, 'all_types', total FROM q)
SELECT *, conditions // 48 AS steps FROM s""")
def scenario_sizes(read) -> DataFrame:
    q = read("orders").select(F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 5).alias("types"))
    return runs.scenario_sizes(q, "split", "types", [1, 2, 4], 48)


@query("""SELECT count(*) AS pairs, count(DISTINCT user_id) AS conditions, CAST(count_if(event_type = 'click') AS DOUBLE) / count(*) AS x_rate, CAST(count_if(event_type = 'view') AS DOUBLE) / count(*) AS y_rate,
 CAST(count_if(event_type NOT IN ('click', 'view')) AS DOUBLE) / count(*) AS tie_rate FROM events""")
def outcome_rates(read) -> DataFrame:
    w = F.when(F.col("event_type") == "click", "x").when(F.col("event_type") == "view", "y").otherwise("tie")
    return runs.outcome_rates(read("events").select("user_id", w.alias("winner")), "user_id")


@query(f"""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY {H.format("doc_id")}, doc_id) AS r FROM documents WHERE lang IN ('en', 'de')),
p AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY r, source, doc_id) AS place FROM r)
SELECT * FROM p WHERE place <= CASE lang WHEN 'en' THEN 25 ELSE 10 END""")
def quota_pick(read) -> DataFrame:
    return splits.spread_pick(read("documents").select("doc_id", "lang", "source"), "lang", {"en": 25, "de": 10}, "source", "doc_id", SEED)


@query("SELECT event_id, sha256(concat_ws('|', '7', 'stage2', event_id)) AS place FROM events")
def stage_permutation(read) -> DataFrame:
    return read("events").select("event_id", splits.stage_order("event_id", SEED, "stage2").alias("place"))


@query("SELECT conv_id, count(*) AS n, count(DISTINCT turn) FILTER (turn >= 0 AND turn < 4) AS inside FROM conversations GROUP BY 1 HAVING count(*) <> 4 OR count(DISTINCT turn) FILTER (turn >= 0 AND turn < 4) <> 4")
def block_integrity(read) -> DataFrame:
    return splits.broken_blocks(read("conversations"), "conv_id", "turn", 4)


@query("SELECT doc_id, text, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS label FROM documents")
def labels_on_rows(read) -> DataFrame:
    d = read("documents")
    return exports.attach(d.select("doc_id", "text"), d.select("doc_id", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("label")), ["doc_id"], "label")


@query("SELECT a.text, a.lang, min(b.source) AS label FROM documents a JOIN documents b ON a.text = b.text AND a.lang = b.lang GROUP BY a.doc_id, a.text, a.lang")
def labels_on_copies(read) -> DataFrame:
    d = read("documents")
    # all documents; the SQL above still has half of them, so it doesn't agree (see README)
    return exports.attach_by_identity(d.select("text", "lang"), d.select("text", "lang", F.col("source").alias("label")), "label")


@query("SELECT event_id, list_sort([event_type, CAST(user_id AS VARCHAR)]) AS verdicts FROM events")
def rollout_verdicts(read) -> DataFrame:
    e = read("events")
    v = e.select("event_id", F.explode(F.array("event_type", F.col("user_id").cast("string"))).alias("verdict"))
    return exports.with_verdicts(e.select("event_id"), v, ["event_id"], "verdict", 2)


def _pair_tables(read) -> tuple[DataFrame, DataFrame]:
    """Documents as cases, and their pairs with the negatives drawn; a tenth of the rows breaks some rule."""
    d = read("documents").select("*", (F.col("doc_id") % 50).alias("g"), F.when(F.col("doc_id") % 10 == 3, "dev").otherwise("train").alias("side"))
    cases = d.select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("dataset"), F.col("g").alias("question_group_id"), F.col("side").alias("split"), F.when(F.col("doc_id") % 30 != 7, "ok").alias("description_status"),
        F.lit(False).alias("prompt_dev_group"), F.lit("").alias("exclusion_reason"),
    )
    drawn = _negatives(read).select(F.col("anchor").alias("anchor_sample_id"), F.col("donor").alias("donor_sample_id"), F.lit("not_aligned").alias("target"))
    own = d.select(F.col("doc_id").alias("anchor_sample_id"), F.col("doc_id").alias("donor_sample_id"), F.lit("aligned").alias("target"))
    # the checks ask of a text only whether it is blank; a letter in its stead is what the joins carry
    told = F.when(~tk.blank(F.col("text")), "x").otherwise("")
    anchor = d.select(F.col("doc_id").alias("anchor_sample_id"), F.col("lang").alias("dataset"), F.col("side").alias("split"), F.col("g").alias("question_group_id"), F.col("source").alias("anchor_source_error_label"), *[told.alias(c) for c in ("question", "solution", "error_description")], F.col("n_chars").alias("n_tokens"))
    donor = d.select(F.col("doc_id").alias("donor_sample_id"), F.col("source").alias("donor_source_error_label"), F.col("g").alias("donor_question_group_id"))
    return cases, own.unionByName(drawn).join(anchor, "anchor_sample_id").join(donor, "donor_sample_id")


@query(f"""WITH n AS ({ORACLES['negative_pairs']}), d AS (SELECT *, doc_id % 50 AS g, CASE WHEN doc_id % 10 = 3 THEN 'dev' ELSE 'train' END AS side, doc_id % 30 <> 7 AS told FROM documents),
p AS (SELECT doc_id AS a, doc_id AS b, true AS pos FROM d UNION ALL SELECT anchor, donor, false FROM n), j AS (SELECT p.pos, x.*, y.side AS dside, y.lang AS dlang, y.g AS dg, y.source AS dsource, y.told AS dtold, y.doc_id AS did FROM p JOIN d x ON p.a = x.doc_id JOIN d y ON p.b = y.doc_id),
t AS (SELECT a, count_if(pos) AS k, count_if(NOT pos) AS n FROM p GROUP BY 1), g AS (SELECT g, count(DISTINCT side) AS k FROM d GROUP BY 1),
r AS (SELECT unnest(['text.present', 'text.length', 'self.donor', 'donor.split', 'donor.label', 'donor.group', 'donor.dataset', 'donor.described']) AS name,
 unnest([count_if(trim(text) = ''), count_if(n_chars > 4096), count_if(pos AND did <> doc_id), count_if(NOT pos AND dside <> side), count_if(NOT pos AND dsource = source), count_if(NOT pos AND dg = g), count_if(NOT pos AND dlang <> lang), count_if(NOT (told AND dtold))]) AS n FROM j
 UNION ALL SELECT 'anchor.targets', count_if(k <> 1 OR n <> 1) FROM t UNION ALL SELECT 'group.split', count_if(k <> 1) FROM g UNION ALL SELECT 'group.prompt', 0)
SELECT name, n = 0 AS passed, n || ' violations' AS detail FROM r""")
def pair_expectations(read) -> DataFrame:
    return checks.pair_checks(*_pair_tables(read), 4096)


_JUDGED = f"""SELECT *, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 3 END AS second FROM ({_RUNS})"""
_PASS = {"p": "shape = 0", "s": "second = 0"}


def _judged_results(read) -> DataFrame:
    i = F.col("event_id")
    aligned, other, bad = F.lit("aligned"), F.lit("not_aligned"), F.lit("invalid")
    second = F.element_at(F.array(F.array(aligned), F.array(other), F.array(bad, aligned)), (i % 3 + 1).cast("int"))
    asked = (F.col("verdict") == "incorrect") & (i % 4 != 3)
    return _results(read).withColumns({"second": F.when(asked, second), "flagged": i % 9 == 0, "total": (i % 4).cast("double")})


_COUNTS15 = f"""SELECT user_id, CAST(sum(rollouts) AS BIGINT) AS rollouts, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(incorrect) AS BIGINT) AS incorrect, CAST(sum("null") AS BIGINT) AS "null", CAST(sum(success) AS BIGINT) AS success,
 CAST(sum(primary_pass) AS BIGINT) AS primary_pass, CAST(sum(verifier_samples) AS BIGINT) AS verifier_samples, CAST(sum(verifier_invalid) AS BIGINT) AS verifier_invalid, CAST(sum(both_judged) AS BIGINT) AS both_judged,
 CAST(sum(secondary_pass) AS BIGINT) AS secondary_pass, CAST(sum(disagree) AS BIGINT) AS disagree, CAST(sum(truncated) AS BIGINT) AS truncated, CAST(sum(total_reward) AS DOUBLE) AS total_reward,
 count(*) AS conditions, count_if(success = 0) AS zero_success_conditions FROM (
 SELECT user_id, condition, count(*) AS rollouts, count_if(verdict = 'correct') AS correct, count_if(verdict = 'incorrect') AS incorrect, count_if(verdict IS NULL) AS "null", count_if(in_g) AS success, count_if(shape = 0) AS primary_pass,
 2 * count(shape) AS verifier_samples, 2 * count_if(shape = 2) AS verifier_invalid, count_if(shape IS NOT NULL AND second IS NOT NULL) AS both_judged, count_if(shape IS NOT NULL AND second = 0) AS secondary_pass,
 count_if(shape IS NOT NULL AND second IS NOT NULL AND (shape = 0) <> (second = 0)) AS disagree, count_if(truncated) AS truncated, sum(event_id % 4) AS total_reward FROM ({_JUDGED}) GROUP BY 1, 2) GROUP BY 1"""


@query(_COUNTS15)
def group_count_vectors(read) -> DataFrame:
    return metrics.group_counts(_judged_results(read), "user_id", "condition", "labels", "second")


@query("SELECT " + ", ".join(f'CAST(sum("{a}") AS DOUBLE) / nullif(sum("{b}"), 0) AS {name}' for name, (a, b) in metrics.JUDGED_RATIOS.items()) + f" FROM ({_COUNTS15})")
def judged_ratios(read) -> DataFrame:
    return metrics.ratio_table(group_count_vectors(read), metrics.JUDGED_RATIOS)


@query(f"""SELECT condition, CAST(count_if(event_id % 9 = 0) AS DOUBLE) / count(*) AS flagged_rate, count_if(shape IS NOT NULL AND second IS NOT NULL) AS both_judged,
 coalesce(CAST(count_if(shape IS NOT NULL AND second = 0) AS DOUBLE) / nullif(count_if(shape IS NOT NULL AND second IS NOT NULL), 0), 0) AS secondary_accept_rate_incorrect,
 coalesce(CAST(count_if(shape IS NOT NULL AND second IS NOT NULL AND (shape = 0) <> (second = 0)) AS DOUBLE) / nullif(count_if(shape IS NOT NULL AND second IS NOT NULL), 0), 0) AS disagreement_rate_incorrect
 FROM ({_JUDGED}) GROUP BY 1""")
def judge_extras(read) -> DataFrame:
    return runs.judge_extras(_judged_results(read), "labels", "second", ("condition",))


@query(f"SELECT k AS stage, count(*) AS n, CAST(count_if(in_g) AS DOUBLE) / count(*) AS success_rate FROM ({_RUNS}) GROUP BY 1")
def stage_success(read) -> DataFrame:
    return runs.stage_success(_results(read).withColumnRenamed("k", "stage"), "stage")


@query("SELECT round(sum(value / 100) / count(*), 9) AS max_bleu_mean, CAST(count_if(value / 100 >= 0.999) AS DOUBLE) / count(*) AS duplicate_rate FROM events WHERE event_type = 'click'")
def diversity_rates(read) -> DataFrame:
    return runs.diversity_rates(read("events").where("event_type = 'click'").select((F.col("value") / 100).alias("s")), "s").withColumn("max_bleu_mean", F.round("max_bleu_mean", 9))


@query("""SELECT count(*) AS pairs, count_if(event_id % 9 = 0) AS flagged_pairs, CAST(count_if(event_type NOT IN ('click', 'view')) AS DOUBLE) / count(*) AS tie_rate, CAST(count_if(event_type = 'click') AS DOUBLE) / count(*) AS a_win_rate FROM events""")
def likeness_rates(read) -> DataFrame:
    w = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").otherwise("tie")
    return runs.likeness_rates(read("events").select(w.alias("winner"), (F.col("event_id") % 9 == 0).alias("flagged")))


_FACETS = {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus", "line": "l_linenumber", "kind": "l_returnflag || l_linestatus", "mode": "l_linenumber % 3", "negative_kind": "l_returnflag", "negative_relation": "l_linestatus"}


@query(f"""WITH p AS ({_PRED}), f AS (""" + " UNION ALL ".join(f"SELECT '{n}' AS facet, CAST({c} AS VARCHAR) AS value, * FROM p" + (" WHERE target = 'not_aligned'" if n.startswith("negative") else "") for n, c in _FACETS.items()) + f"""),
c AS (SELECT facet, value, {_COUNTS} FROM f GROUP BY 1, 2), a AS (SELECT facet, value, l_orderkey, count(DISTINCT target) AS k, bool_and(target = prediction) AS ok FROM f GROUP BY 1, 2, 3),
r AS (SELECT facet, value, count_if(k = 2) AS pairs, count_if(k = 2 AND ok) AS "right" FROM a GROUP BY 1, 2)
SELECT *, CAST("right" AS DOUBLE) / nullif(pairs, 0) AS pair_accuracy FROM c JOIN r USING (facet, value) WHERE n >= 10""")
def facet_breakdown(read) -> DataFrame:
    facets = {n: F.expr(c) for n, c in _FACETS.items()}
    return metrics.facet_breakdown(_predictions(read), facets, 10, "l_orderkey", "correct", ("negative_kind", "negative_relation"))


@query("SELECT sum(l_discount * l_quantity) / sum(l_quantity) AS loss, sum(l_quantity) AS tokens FROM (SELECT l_discount, CAST(l_linenumber AS BIGINT) AS l_quantity FROM lineitem)")
def token_weighted_loss(read) -> DataFrame:
    return metrics.token_weighted_mean(read("lineitem").select("l_discount", F.col("l_linenumber").cast("long").alias("l_quantity")), "l_discount", "l_quantity")


_CLUSTERS = """WITH c AS (SELECT o_custkey AS g, o_orderpriority AS model, count_if(l_returnflag = 'R') AS a, count(*) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
g AS (SELECT g, row_number() OVER (ORDER BY sha256(concat_ws('|', '7', g)), g) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM c)),
d AS (SELECT replicate, CAST(('0x' || substr(sha256(concat_ws('|', '7', replicate, place)), 1, 8)) AS BIGINT) % n AS place FROM g, range(0, 200) r(replicate)),
t AS (SELECT replicate, g, count(*) AS times FROM d JOIN g USING (place) GROUP BY 1, 2)"""


def _clusters(read) -> DataFrame:
    o = read("orders").select("o_orderkey", F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("model"))
    c = read("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("g", "model").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count(F.lit(1)).alias("b"))
    return stored(c, "clusters")


@query(_CLUSTERS + """, b AS (SELECT x.model, x.g, x.a, x.b, y.a AS ra, y.b AS rb FROM c x JOIN c y ON x.g = y.g AND y.model = '1-URGENT' WHERE x.model <> '1-URGENT'),
v AS (SELECT model, replicate, CAST(sum(a * times) AS DOUBLE) / sum(b * times) - CAST(sum(ra * times) AS DOUBLE) / sum(rb * times) AS value FROM b JOIN t USING (g) GROUP BY 1, 2),
p AS (SELECT model, CAST(sum(a) AS DOUBLE) / sum(b) - CAST(sum(ra) AS DOUBLE) / sum(rb) AS point FROM b GROUP BY 1)
SELECT model, round(any_value(point), 9) AS point, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, count(*) AS replicates FROM v JOIN p USING (model) GROUP BY 1""")
def paired_difference(read) -> DataFrame:
    r = stats.paired_difference(_clusters(read), "g", "model", "1-URGENT", "a", "b", 200, SEED)
    return r.select("model", *[F.round(c, 9).alias(c) for c in ("point", "low", "high")], "replicates")


@query(_CLUSTERS + """, v AS (SELECT model, replicate, CAST(sum(a * times) AS DOUBLE) / sum(b * times) AS value FROM c JOIN t USING (g) GROUP BY 1, 2), l AS (SELECT model, list_sort(list(value)) AS v FROM v GROUP BY 1)
SELECT model, round(v[1 + CAST(floor(0.025 * len(v)) AS BIGINT)], 9) AS low, round(v[1 + CAST(floor(0.975 * len(v)) AS BIGINT)], 9) AS high FROM l""")
def bootstrap_index(read) -> DataFrame:
    r = stats.index_interval(stats.replicate_ratios(_clusters(read), "g", ["model"], "a", "b", 200, SEED), ["model"])
    return r.select("model", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("""WITH d AS (SELECT lang AS region, source AS type, CASE WHEN doc_id % 5 = 0 AND source <> 'web' THEN 'not_aligned' ELSE 'aligned' END AS target, CASE WHEN doc_id % 7 = 0 THEN [source] ELSE [] END AS removed FROM documents),
g AS (SELECT * FROM (SELECT DISTINCT region FROM d), (SELECT DISTINCT type FROM d)), c AS (SELECT region, type, count_if(target = 'aligned') AS p, count_if(target = 'not_aligned') AS n, CAST(sum(len(removed)) AS BIGINT) AS r FROM d GROUP BY 1, 2)
SELECT region, type, coalesce(p, 0) AS positives, coalesce(n, 0) AS negatives, coalesce(r, 0) AS removed, coalesce(p, 0) > 0 AND coalesce(n, 0) = 0 AS no_negatives FROM g LEFT JOIN c USING (region, type)""")
def full_audit(read) -> DataFrame:
    d = read("documents").select(F.col("lang").alias("region"), F.col("source").alias("type"), F.when((F.col("doc_id") % 5 == 0) & (F.col("source") != "web"), "not_aligned").otherwise("aligned").alias("target"), (F.col("doc_id") % 7 == 0).alias("gone"))
    manifest = d.select("region", F.when(F.col("gone"), F.array("type")).otherwise(F.array().cast("array<string>")).alias("removed"))
    return pairs.full_audit(d, manifest, "region", d.select("type"))


@query(f"""WITH r AS (SELECT o_custkey, row_number() OVER (ORDER BY {H.format("o_custkey")}, o_custkey) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_custkey, CASE WHEN r <= ceil(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM r""")
def ceil_split(read) -> DataFrame:
    return splits.ceil_split(read("orders"), "o_custkey", 0.8, SEED)


@query("""WITH u AS (SELECT o_custkey AS g, o_orderpriority AS s, 1 AS f FROM orders UNION ALL SELECT c_custkey, c_mktsegment, 2 FROM customer),
v AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, s) AS r FROM u GROUP BY 1, 2)
SELECT g, count(*) AS n_rows, count(DISTINCT f) = 2 AS in_both, any_value(v.s) AS s FROM u JOIN (SELECT g, s FROM v WHERE r = 1) v USING (g) GROUP BY 1""")
def global_groups(read) -> DataFrame:
    a = read("orders").select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("s"))
    return splits.global_groups(a, read("customer").select(F.col("c_custkey").alias("g"), F.col("c_mktsegment").alias("s")), "g", "s")


@query(f"""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS anchor, type, unit, l_linenumber % 3 = 1 AS elig FROM lineitem, (VALUES ('A', false), ('N', false), ('R', true), ('U', true)) t(type, unit) WHERE l_returnflag <> type AND (NOT unit OR l_linenumber % 3 = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY NOT (elig AND unit), {H.format("anchor, type")}) AS r FROM t)
SELECT anchor, type, CASE WHEN elig AND unit THEN 'unit_priority' ELSE 'uniform' END AS draw FROM r WHERE r = 1""")
def type_draw(read) -> DataFrame:
    li = read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("anchor"), "l_returnflag", (F.col("l_linenumber") % 3 == 1).alias("eligible"))
    types = li.sparkSession.createDataFrame([("A", False), ("N", False), ("R", True), ("U", True)], "type string, unit boolean")
    return pairs.draw(pairs.candidates(li, types, "l_returnflag", "unit", "eligible"), "anchor", SEED, "unit", "eligible")


@query(f"""WITH d AS (SELECT {KEY} AS k, doc_id, CASE WHEN n_chars < 50 THEN 'too_short' ELSE '' END AS reason FROM documents), e AS (SELECT k, count(*) AS n FROM d WHERE reason = '' GROUP BY 1)
SELECT (SELECT count(*) FROM d) AS records_read, CAST(sum(n) AS BIGINT) AS eligible_records, count(*) AS unique_requests, CAST(sum(n - 1) AS BIGINT) AS duplicate_records FROM e""")
def pool_stats(read) -> DataFrame:
    d = read("documents").select(F.sha2(tk.text_key(F.col("text")), 256).alias("k"), curation.first_reason([(F.col("n_chars") < 50, "too_short")]).alias("reason"))
    return curation.pool_stats(d, ["k"])


@query(f"SELECT sha256({KEY}) AS k, list(doc_id ORDER BY doc_id) AS source_ids FROM documents GROUP BY 1")
def pool_sources(read) -> DataFrame:
    d = read("documents").select("doc_id", F.sha2(tk.text_key(F.col("text")), 256).alias("k"))
    return curation.pool_sources(d, ["k"], "doc_id", "doc_id")


#: Columns of canonical records that SQL has too: the group key needs NFKC.
_RECORD = ["source_id", "sample_id", "question", "incorrect_solution", "source_error_label", "stratum", "eligible", "exclusion_reason"]


def _canonical_sql(dataset: str, file: str, question: str, solution: str, label: str, before: str, rules: str, table: str = "documents") -> str:
    """The SQL of a corpus: before and rules are WHEN branches around that of missing fields."""
    mark = "\u241f"
    ends = "' ' || chr(10) || chr(9)"
    return f"""WITH r AS (SELECT *, {file} || '#' || doc_id AS source_id, {question} AS question, {solution} AS incorrect_solution, {label} AS source_error_label FROM {table}),
m AS (SELECT *, array_to_string(list_filter([CASE WHEN trim(question, {ends}) = '' THEN 'question' END, CASE WHEN trim(incorrect_solution, {ends}) = '' THEN 'incorrect_solution' END, CASE WHEN trim(source_error_label) = '' THEN 'source_error_label' END], lambda x: x IS NOT NULL), ',') AS missing FROM r),
e AS (SELECT *, CASE {before} WHEN missing <> '' THEN 'missing_field:' || missing {rules} ELSE '' END AS exclusion_reason FROM m)
SELECT source_id, '{dataset}:' || substr(sha256(concat_ws('{mark}', trim(question, {ends}), trim(incorrect_solution, {ends}), trim(source_error_label))), 1, 16) AS sample_id, question, incorrect_solution, source_error_label, trim(source_error_label) AS stratum, exclusion_reason = '' AS eligible, exclusion_reason FROM e"""


def _raw(read, file: Column, **fields: Column) -> DataFrame:
    return read("documents").select(file.alias("file"), F.col("doc_id").alias("row"), F.struct(*[c.alias(k) for k, c in fields.items()]).alias("record"))


_LABEL4 = "CASE doc_id % 4 WHEN 0 THEN '{0}' WHEN 1 THEN '{1}' WHEN 2 THEN '' ELSE '{2}' END"


def _label4(*names: str) -> Column:
    k = F.col("doc_id") % 4
    return F.when(k == 0, names[0]).when(k == 1, names[1]).when(k == 2, "").otherwise(names[2])


@query(_canonical_sql("stepwise", "'s.json'", "CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END", "array_to_string(string_split(lang || '|' || source, '|'), chr(10))", _LABEL4.format("calc", "None of the above", "logic"), "", "WHEN lower(trim(source_error_label)) IN ('none of the above', 'none', 'no error') THEN 'non_error_label'"))
def stepwise_records(read) -> DataFrame:
    steps = F.to_json(F.split(F.concat("lang", F.lit("|"), "source"), r"\|"))
    question = F.when(F.col("doc_id") % 9 != 0, F.col("source"))
    nothing = F.lit(None).cast("string")
    raw = _raw(read, F.lit("s.json"), problem=question, student_incorrect_solution=steps, error_category=_label4("calc", "None of the above", "logic"), incorrect_index=F.lit(None).cast("int"), incorrect_step=nothing, topic=nothing)
    return corpora.canonical(raw, corpora.STEPWISE).select(_RECORD)


@query(_canonical_sql("mathclean", "'check/simple.json'", "source", "lang", _LABEL4.format("logic error", "right", "Computing Error"), "", "WHEN lower(trim(source_error_label)) NOT IN ('logic error', 'computing error', 'expression error') THEN 'label_outside_error_types:' || source_error_label"))
def mathclean_records(read) -> DataFrame:
    raw = _raw(read, F.lit("check/simple.json"), question=F.col("source"), answer=F.col("lang"), type=_label4("logic error", "right", "Computing Error"), extent=F.lit("x"))
    return corpora.canonical(raw, corpora.MATHCLEAN).select(_RECORD)


_EIC_FOLDER = "CASE WHEN doc_id % 3 = 0 THEN 'wrong_step_x' ELSE 'missing_step' END"


@query(_canonical_sql("eic", f"'generated_cases_GSM8K/' || ({_EIC_FOLDER}) || '/c.jsonl'", "source", "lang", _LABEL4.format("missing_step", "other", "unit_conversion_error"), "", f"""WHEN ({_EIC_FOLDER}) <> 'missing_step' THEN 'non_error_type_directory:wrong_step_x' WHEN source_error_label = 'other' THEN 'label_outside_canonical_set:other'
 WHEN doc_id % 5 = 0 THEN 'is_single_error_not_true'"""))
def eic_records(read) -> DataFrame:
    folder = F.when(F.col("doc_id") % 3 == 0, "wrong_step_x").otherwise("missing_step")
    file = F.concat(F.lit("generated_cases_GSM8K/"), folder, F.lit("/c.jsonl"))
    raw = _raw(read, file, question=F.col("source"), transformed_solution=F.col("lang"), wrong_type=_label4("missing_step", "other", "unit_conversion_error"), is_single_error=F.when(F.col("doc_id") % 5 != 0, F.lit(True)), wrong_step=F.lit("1"), explanation=F.lit("e"))
    return corpora.canonical(corpora.eic_rows(raw, ["GSM8K"]), corpora.EIC).select(_RECORD)


_EDU = "(SELECT d.*, coalesce(q.p_name, '') AS asked, doc_id % 5 AS errors FROM documents d LEFT JOIN part q ON d.doc_id = q.p_partkey)"


@query(_canonical_sql("mathedu", "'train.json'", "asked", "lang", "CASE WHEN errors = 1 THEN source ELSE '' END", """WHEN doc_id % 7 = 0 THEN 'not_an_incorrect_answer:right' WHEN errors = 0 THEN 'no_teacher_annotated_error' WHEN errors > 1 THEN 'multiple_annotated_errors:' || errors WHEN trim(asked) = '' THEN 'mathqa_question_not_found'""", "", _EDU))
def mathedu_records(read) -> DataFrame:
    error = F.struct(F.col("source").alias("error_type"), F.lit("e").alias("error_equation"), F.lit("a").alias("teacher_advice_en"), F.lit("b").alias("teacher_advice_ch"))
    n = (F.col("doc_id") % 5).cast("int")
    review = F.struct(n.alias("error_counts"), F.array_repeat(error, n).alias("error"))
    raw = _raw(read, F.lit("train.json"), id=F.col("doc_id"), student_id=F.lit("s"), student_process=F.col("lang"), correct_or_not=F.when(F.col("doc_id") % 7 == 0, "right").otherwise("Wrong"), teacher_review=review)
    questions = read("part").select(F.col("p_partkey").alias("position"), "p_name")
    return corpora.canonical(corpora.with_questions(raw, questions, F.col("record.id"), "p_name"), corpora.MATHEDU).select(_RECORD)


@query("SELECT lang, doc_id FROM documents WHERE lang IN ('en', 'de') AND doc_id IN (SELECT doc_id FROM labels JOIN documents USING (doc_id) WHERE lang IN ('en', 'de'))")
def run_selection(read) -> DataFrame:
    d = read("documents")
    ids = read("labels").select("doc_id").join(d.where(F.col("lang").isin("en", "de")).select("doc_id"), "doc_id")
    return eligibility.select_run(d, "doc_id", "lang", ["en", "de"], ids).select("lang", "doc_id")


@query("SELECT p_partkey, p_brand AS label, 'T' || length(p_brand) AS type_id, CASE WHEN p_brand < 'Brand#2' THEN 'adopted' ELSE 'excluded' END AS type_status FROM part")
def taxonomy_resolution(read) -> DataFrame:
    p = read("part").select("p_partkey", F.lit("part").alias("dataset"), F.col("p_brand").alias("label"))
    status = F.when(F.col("label") < "Brand#2", "adopted").otherwise("excluded")
    taxonomy = p.select("dataset", F.col("label").alias("alias"), F.concat(F.lit("T"), F.length("label")).alias("type_id"), status.alias("status")).distinct()
    return eligibility.resolve_types(p, taxonomy, "dataset", "label").select("p_partkey", "label", "type_id", "type_status")


@query("SELECT doc_id, CASE WHEN n_chars < 50 THEN 'short' WHEN l.doc_id IS NOT NULL THEN 'held_out' ELSE '' END AS reason FROM documents LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)".replace("l.doc_id IS NOT NULL", "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def held_out_cases(read) -> DataFrame:
    cases = read("documents").select("doc_id", curation.first_reason([(F.col("n_chars") < 50, "short")]).alias("reason"))
    return eligibility.hold_out(cases, read("labels").where("toxic = 1"), "doc_id", "reason")


@query(f"""WITH c AS (SELECT doc_id, {KEY} AS k, source AS l FROM documents), x AS (SELECT * FROM c UNION ALL SELECT NULL, k, 'other' FROM c WHERE doc_id % 13 = 0),
b AS (SELECT k, count(DISTINCT l) FILTER (doc_id IS NOT NULL) = 1 AS only_extra FROM x GROUP BY 1 HAVING count(DISTINCT l) > 1)
SELECT doc_id, CASE WHEN b.k IS NOT NULL THEN 'multi_label_solution' ELSE '' END AS reason, coalesce(only_extra, false) AS only_extra FROM c LEFT JOIN b USING (k)""")
def conflict_exclusion(read) -> DataFrame:
    c = read("documents").select("doc_id", F.sha2(tk.text_key(F.col("text")), 256).alias("k"), F.col("source").alias("l"), F.lit("").alias("reason"))
    extra = c.where("doc_id % 13 = 0").select("k", F.lit("other").alias("l"))
    return eligibility.exclude_conflicts(c, ["k"], "l", "reason", extra).select("doc_id", "reason", "only_extra")


@query("""WITH s AS (SELECT lang, unnest(['chars', 'quarter']) AS tokenizer, unnest([n_chars, n_chars // 4]) AS t FROM documents)
SELECT lang, tokenizer, count(*) AS n, max(t) AS longest, quantile_cont(t, 0.99) AS p99, count_if(t > 1024) AS over FROM s GROUP BY 1, 2""")
def tokenizer_lengths(read) -> DataFrame:
    lengths = {"chars": F.col("n_chars"), "quarter": F.floor(F.col("n_chars") / 4)}
    return eligibility.length_check(read("documents"), "doc_id", lengths, 1024, "lang")[1]


@query("""WITH r AS (SELECT l_partkey AS k, CASE WHEN min(l_linenumber % 2) = max(l_linenumber % 2) THEN min(l_linenumber % 2) = 1 END AS v FROM lineitem GROUP BY 1),
x AS (SELECT p_partkey AS k FROM part WHERE p_size % 3 = 0)
SELECT coalesce(r.k, x.k) AS k, CASE WHEN r.k IS NULL THEN true WHEN x.k IS NULL THEN v WHEN v THEN true END AS eligible, CASE WHEN r.k IS NULL THEN 'extra' WHEN v IS NULL OR (x.k IS NOT NULL AND NOT v) THEN 'ambiguous' ELSE 'rows' END AS source FROM r FULL JOIN x ON r.k = x.k""")
def unit_eligibility(read) -> DataFrame:
    rows = read("lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_linenumber") % 2 == 1).alias("v"))
    return eligibility.eligibility(rows, "k", "v", read("part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("k")))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'other keys' WHEN 2 THEN 'a text for null' WHEN 3 THEN 'a verdict without an answer' ELSE '' END AS fault,
 CASE WHEN event_id % 6 = 4 THEN event_type END AS extracted_answer, CASE WHEN event_id % 6 = 4 THEN 'correct' END AS verdict FROM events""")
def answer_faults(read) -> DataFrame:
    k = F.col("event_id") % 6
    text = lambda a, v: F.concat(F.lit('{"extracted_answer": '), a, F.lit(', "verdict": '), v, F.lit(', "reason": "r"}'))
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    null = F.lit("null")
    raw = F.when(k == 0, F.lit("{")).when(k == 1, F.col("props")).when(k == 2, text(F.lit('"null"'), null)).when(k == 3, text(null, F.lit('"correct"'))).when(k == 4, text(quoted, F.lit('"correct"'))).otherwise(text(null, null))
    return answers.answer_check(read("events").select("event_id", raw.alias("t")), "t").select("event_id", "fault", "extracted_answer", "verdict")


@query("""SELECT p_partkey, 'A: ' || p_type || chr(10) || 'B: ' || p_brand AS options, CASE WHEN p_size % 4 = 0 THEN 'unjudgeable' WHEN p_size % 4 = 1 THEN 'target' WHEN p_size % 4 = 2 THEN 'other' ELSE 'none' END AS matched FROM part""")
def matched_options(read) -> DataFrame:
    k = F.col("p_size") % 4
    answer = F.when(k == 1, F.concat(F.lit("$"), "p_type", F.lit(" $"))).when(k == 2, F.col("p_brand")).when(k == 3, "nothing like it")
    options = F.array(F.struct(F.lit("B").alias("option"), F.col("p_brand").alias("text")), F.struct(F.lit("A").alias("option"), F.col("p_type").alias("text")))
    return read("part").select("p_partkey", answers.options_text(options).alias("options"), answers.matched_class(answer, {"target": F.array("p_type"), "other": F.array("p_brand")}).alias("matched"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d_%H%M%S') AS stamp FROM events")
def seoul_stamps(read) -> DataFrame:
    return read("events").select("event_id", settings.stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("""WITH a AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN lang || '?' ELSE lang END AS lang, source FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, unnest(['lang', 'source']) AS "column", unnest([a.lang, a.source]) AS "left", unnest([b.lang, b.source]) AS "right" FROM a FULL JOIN b USING (doc_id) WHERE a.lang IS NULL OR b.lang IS NULL
UNION ALL SELECT doc_id, 'lang', a.lang, b.lang FROM a JOIN b USING (doc_id) WHERE a.lang <> b.lang""")
def table_difference(read) -> DataFrame:
    d = read("documents").select("doc_id", "lang", "source")
    b = d.where("doc_id % 5 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 == 0, F.concat("lang", F.lit("?"))).otherwise(F.col("lang")))
    return checks.table_difference(d.where("doc_id % 7 <> 0"), b, "doc_id", ["lang", "source"])


@query(f"SELECT lang, {KEY} AS k FROM documents UNION ALL SELECT role, {KEY} FROM conversations".replace(KEY, f"sha256({KEY})"))
def pooled_texts(read) -> DataFrame:
    key = F.sha2(tk.text_key(F.col("text")), 256).alias("k")
    return read("documents").select("lang", key).unionByName(read("conversations").select(F.col("role").alias("lang"), key))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_histogram(read) -> DataFrame:
    return read("events").groupBy("event_type").agg(n())
