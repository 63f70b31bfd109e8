"""Queries for what must hold at any size: driverless splits, selection, samples of pairs, automata, gates in one pass, sinks and joins of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contamination, dedup, packing, sampling, selection, splits, stats, validate
from ..session import materialised, shared_folder
from ..sources import records, token_sink
from ..streaming import incremental
from .catalog import NORM, PAIR_COUNTS, PAIRS, SHINGLES, _IDS, hashed, pairs, query, shingles_about, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- streams ---------------------------------------------------------------------------------------------------------


@query(f"WITH {PAIR_COUNTS} SELECT a, b, common, na, nb FROM counted WHERE common * 10 >= (na + nb - common) * 9")
def stream_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, one second an id: the horizon covers them all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    timed = stream.withColumn("at", F.timestamp_seconds(F.col("doc_id") + 86_400))
    order = dedup.often(dedup.hashed(docs, F.col("text"), "doc_id"), shingles_about(docs))
    met = incremental.meeting_tokens(docs, "doc_id", "text", order=order)
    found = incremental.drained(incremental.near_candidates(timed, "doc_id", "text", "at", horizon="3650 days", late="3650 days", order=order, met=met), "stream_near_pairs")
    return incremental.verified(found, docs, "doc_id", "text")


@query("SELECT a.user_id, a.event_id AS click_id, b.event_id AS purchase_id, (epoch_us(b.ts) - epoch_us(a.ts)) // 1000000 AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR")
def stream_click_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of the same user in the six hours after, as two streams."""
    kind = lambda k: incremental.events(spark, sf_dir).where(F.col("event_type") == k).select("user_id", "event_id", "ts")
    met = incremental.followed(kind("click"), kind("purchase"), "user_id", "ts", "6 hours", "2 hours", "2 hours")
    gap = F.floor((F.unix_micros("then_ts") - F.unix_micros("first_ts")) / 1_000_000)
    return incremental.drained(met.select(F.col("first_user_id").alias("user_id"), F.col("first_event_id").alias("click_id"), F.col("then_event_id").alias("purchase_id"), gap.alias("seconds")), "stream_click_purchases")


# --- splits ----------------------------------------------------------------------------------------------------------

_GREEDY = """WITH RECURSIVE f AS (SELECT conv_id, count(*) AS n, sha256('42' || conv_id::VARCHAR) AS d FROM conversations GROUP BY conv_id),
  t AS (SELECT sum(n)::DOUBLE AS total, count(*) AS families FROM f),
  s AS (SELECT conv_id, n, row_number() OVER (ORDER BY n, conv_id) AS k FROM f),
  r AS (SELECT conv_id, CASE WHEN k = 1 AND families >= 3 THEN 'validation' WHEN k = 2 AND families >= 3 THEN 'test' END AS split FROM s, t),
  o AS (SELECT f.conv_id, n, row_number() OVER (ORDER BY d) AS k FROM f JOIN r USING (conv_id) WHERE split IS NULL),
  g(k, conv_id, split, a, b, c) AS (
    SELECT 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, coalesce((SELECT sum(n) FROM f JOIN r USING (conv_id) WHERE split = 'validation'), 0)::BIGINT, coalesce((SELECT sum(n) FROM f JOIN r USING (conv_id) WHERE split = 'test'), 0)::BIGINT
    UNION ALL
    SELECT o.k, o.conv_id, w, g.a + CASE WHEN w = 'train' THEN n ELSE 0 END, g.b + CASE WHEN w = 'validation' THEN n ELSE 0 END, g.c + CASE WHEN w = 'test' THEN n ELSE 0 END
    FROM g JOIN o ON o.k = g.k + 1, t, LATERAL (SELECT CASE WHEN total * 0.9::DOUBLE - a >= total * 0.05::DOUBLE - b AND total * 0.9::DOUBLE - a >= total * 0.05::DOUBLE - c THEN 'train' WHEN total * 0.05::DOUBLE - b >= total * 0.05::DOUBLE - c THEN 'validation' ELSE 'test' END AS w)
  )
"""


@query(_GREEDY + "SELECT c.conv_id, c.turn, coalesce(r.split, g.split) AS split FROM conversations c JOIN r USING (conv_id) LEFT JOIN g ON g.conv_id = c.conv_id")
def family_split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.family_split(table(spark, sf_dir, "conversations"), "conv_id", "conv_id").select("conv_id", "turn", "split")


# --- selection and samples -------------------------------------------------------------------------------------------

_AT = (0.5, 0.9, 0.95, 0.99)


@query(
    "WITH s AS (SELECT total, row_number() OVER (ORDER BY total) AS r, count(*) OVER () AS n FROM sales WHERE total IS NOT NULL), l AS (SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, total AS lower FROM s WHERE r = floor((n - 1) * {q}::DOUBLE) + 1" for q in _AT)
    + ")), i AS ("
    + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(total, {q}::DOUBLE), 6) AS linear FROM s" for q in _AT)
    + ") SELECT q, lower, linear FROM l JOIN i USING (q)"
)
def sale_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "sales").select("total")
    lower, linear = (f(held, "total", list(_AT)) for f in (stats.lower_quantiles, stats.linear_quantiles))
    return lower.withColumnRenamed("value", "lower").join(linear.select("q", F.round("value", 6).alias("linear")), "q")


@query()
def similarity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity audit from 10,000 draws; tests hold the estimates against the exact audit."""
    return selection.sampled_audit(materialised(hashed(spark, sf_dir)), "doc_id", 10_000)


# --- containment -----------------------------------------------------------------------------------------------------


@query("WITH i AS (SELECT item_id, unnest([array_to_string(string_split(text, ' ')[1:3], ' '), string_split(text, ' ')[1]]) AS t FROM benchmark) SELECT item_id AS item, count(DISTINCT doc_id) AS documents FROM i JOIN documents d ON i.t <> '' AND contains(d.text, i.t) GROUP BY item_id")
def benchmark_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold an item's first word or first three words: items of one word and of several."""
    words = F.split("text", " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.concat_ws(" ", F.slice(words, 1, 3)), words[0])).alias("text"))
    found = contamination.containments(table(spark, sf_dir, "documents"), items, "doc_id", "item_id")
    return found.groupBy("item").agg(F.count("*").alias("documents"))


# --- grouping sets ---------------------------------------------------------------------------------------------------

_SETS = [(), ("lang",), ("quality",), ("toxic",), ("size",), ("lang", "quality"), ("lang", "toxic"), ("lang", "size"), ("quality", "size")]


@query(
    "WITH d AS (SELECT coalesce(lang, 'unknown') AS lang, coalesce(quality::VARCHAR, 'unknown') AS quality, coalesce(toxic::VARCHAR, 'unknown') AS toxic, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS size FROM documents LEFT JOIN labels USING (doc_id)) "
    f"SELECT {', '.join(f"CASE WHEN grouping({c}) = 1 THEN '*' ELSE {c} END AS {c}" for c in ('lang', 'quality', 'toxic', 'size'))}, count(*) AS n FROM d GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(s) + ')' for s in _SETS)})"
)
def document_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return stats.margins(held, {"lang": F.col("lang"), "quality": F.col("quality"), "toxic": F.col("toxic"), "size": size}, _SETS)


# --- gates, lines and sinks ------------------------------------------------------------------------------------------

_REASONS = ["too_short", "too_long", "shouting", "no_letters"]


def _document_reason():
    text = F.col("text")
    letters, capitals = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit("[A-Z]"))
    return F.when(F.length(text) < 200, "too_short").when(F.length(text) > 20_000, "too_long").when(letters == 0, "no_letters").when(capitals * 20 > letters, "shouting")


@query(
    "WITH d AS (SELECT doc_id, CASE WHEN length(text) < 200 THEN 'too_short' WHEN length(text) > 20000 THEN 'too_long' WHEN l = 0 THEN 'no_letters' WHEN c * 20 > l THEN 'shouting' END AS reason FROM (SELECT *, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS c FROM documents)), "
    "s AS (SELECT coalesce(reason, 'accepted') AS name, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM d GROUP BY 1), k(name) AS (VALUES ('accepted'), ('too_short'), ('too_long'), ('shouting'), ('no_letters')) "
    "SELECT name, coalesce(n, 0) AS observed, coalesce(n, 0) AS written, coalesce(ids, 0) AS ids FROM k LEFT JOIN s USING (name)"
)
def gated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected documents written in one pass, the counts observed on the way, and what was written read again."""
    path = _folder(spark, "gated")
    counters = records.gated(table(spark, sf_dir, "documents"), _document_reason(), path, _REASONS)
    names = ["accepted", *_REASONS]
    sides = records.gate_side(spark, path, "accepted").unionByName(records.gate_side(spark, path, "rejected"))
    written = sides.groupBy(F.coalesce("reason", F.lit("accepted")).alias("name")).agg(F.count("*").alias("written"), F.sum("doc_id").alias("ids"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counters.where(F.col("name").isin(names)).withColumnRenamed("n", "observed").join(written, "name", "left").select("name", "observed", zero("written"), zero("ids"))


@query("SELECT doc_id // 1000 AS bucket, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY doc_id) AS line, doc_id, doc_id % 9 <> 0 AS ok FROM documents")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, a file for each thousand ids, every ninth line broken; read again in pieces, each line with its number."""
    path = _folder(spark, "lines")
    docs = table(spark, sf_dir, "documents").withColumn("bucket", F.floor(F.col("doc_id") / 1000))
    line = F.to_json(F.struct("doc_id", "text"))
    value = F.when(F.col("doc_id") % 9 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" broken"))).otherwise(line)
    docs.select("bucket", "doc_id", value.alias("value")).repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(path)
    found = records.read_numbered(spark, path)
    own = F.coalesce(F.get_json_object("value", "$.doc_id"), F.regexp_extract("value", r"^(\d+) broken$", 1)).cast("bigint")
    return found.select(F.regexp_extract("file", r"bucket=(-?\d+)", 1).cast("bigint").alias("bucket"), "line", own.alias("doc_id"), "ok")


@query(
    f"WITH w AS (SELECT doc_id, list_transform(string_split({NORM.format('text')}, ' '), lambda x: length(x) + 10) AS ids FROM documents) "
    "SELECT doc_id, len(ids) AS n, list_sum(ids)::BIGINT AS total, list_sum(list_transform(ids, lambda x, i: x * i))::BIGINT AS ordered FROM w"
)
def packed_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' stand-in token ids written as a packed cache with labels (the document's id in each place) and read again."""
    path = _folder(spark, "packed").removeprefix("file://")
    ids = F.transform(F.split(T.dedup_form(F.col("text")), " "), lambda w: F.length(w) + 10)
    rows = table(spark, sf_dir, "documents").select(ids.alias("ids"), F.transform(ids, lambda _: F.col("doc_id").cast("int")).alias("labels"))
    token_sink.write_packed(rows, path)
    held = token_sink.read_packed(spark, path)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return held.select(F.col("labels")[0].cast("bigint").alias("doc_id"), F.size("ids").cast("bigint").alias("n"), add(F.col("ids")).alias("total"), add(F.transform("ids", lambda x, i: x.cast("bigint") * (i + 1))).alias("ordered"))


# --- budgets, progress and cache gates -------------------------------------------------------------------------------

_WORDS = f"SELECT len(string_split({NORM.format('text')}, ' ')) AS w FROM documents"


@query(f"WITH t AS ({_WORDS}), c AS (SELECT unnest({list(stats.CANDIDATES)} || [1024, 4096, 16384, 65536]) AS length), k AS (SELECT length, count(*) FILTER (w > length) AS truncated FROM c, t GROUP BY length) SELECT coalesce(min(length) FILTER (truncated = 0), max(length)) AS length FROM k")
def sequence_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least candidate length that cuts no document."""
    held = table(spark, sf_dir, "documents").select(F.greatest(F.lit(1), F.size(T.words(F.col("text")))).alias("w"))
    return stats.selected_length(stats.sequence_candidates(held, "w", (*stats.CANDIDATES, 1024, 4096, 16_384, 65_536)), fallback=True)


@query(
    f"WITH {PAIRS}, a AS (SELECT count(*) AS n, sum(len(string_split(instruction, ' ')) + len(string_split(response, ' ')) + 2)::BIGINT AS t, sum(len(string_split(response, ' ')) + 1)::BIGINT AS s FROM pairs) "
    "SELECT n AS examples, t AS tokens, s AS supervised, t - s AS ignored, n * 256 - t AS static_padding, round((t - n) / n * 8, 6) AS positions_per_update, round(s / n * 8, 6) AS supervised_per_update, ceil(n / 8)::BIGINT AS updates_per_pass, (ceil(n / 8) * 2)::BIGINT AS steps, t - n AS positions_per_pass FROM a"
)
def budget_expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.size(F.split(c, " "))
    held = pairs(spark, sf_dir).select((size("instruction") + size("response") + 2).alias("t"), (size("response") + 1).alias("s"))
    row = stats.budget_expectations(held, "t", "s", 256)
    return row.withColumns({c: F.round(c, 6) for c in ("positions_per_update", "supervised_per_update")})


_LOG = "SELECT event_id AS step, event_id * 2048 AS tokens_seen, CASE WHEN event_type <> 'purchase' THEN value END AS train_loss, CASE WHEN event_type = 'purchase' THEN value END AS validation_loss, 1 / (1 + event_id) AS learning_rate, CASE WHEN event_type <> 'signup' THEN value / 10 END AS gradient_norm, user_id::DOUBLE AS tokens_per_second FROM events"


@query(
    f"WITH l AS ({_LOG}), t AS (SELECT * FROM l WHERE train_loss IS NOT NULL), v AS (SELECT * FROM l WHERE validation_loss IS NOT NULL), r AS (SELECT * FROM t ORDER BY step DESC LIMIT 20), "
    "a AS (SELECT max(step) AS current_step, arg_max(tokens_seen, step) AS tokens_seen, round(arg_max(learning_rate, step), 12) AS learning_rate, arg_min(train_loss, step) AS initial_train_loss, arg_max(train_loss, step) AS latest_train_loss, min(train_loss) AS best_train_loss FROM t), "
    "b AS (SELECT arg_min(validation_loss, step) AS f, arg_max(validation_loss, step) AS latest_validation_loss, min(validation_loss) AS best_validation_loss, (SELECT min(step) FROM v WHERE validation_loss = (SELECT min(validation_loss) FROM v)) AS best_validation_step FROM v), "
    "c AS (SELECT round(avg(gradient_norm), 9) AS recent_gradient_norm, round(avg(tokens_per_second), 9) AS recent_tokens_per_second FROM r) "
    "SELECT a.*, b.* EXCLUDE (f), c.*, latest_train_loss < initial_train_loss AS train_loss_decreasing, latest_validation_loss <= f AS validation_loss_improving, latest_validation_loss > latest_train_loss * 1.25::DOUBLE AS divergence_warning FROM a, b, c"
)
def training_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a metrics log: purchases are validation rows, all others training rows."""
    kind, value, step = F.col("event_type"), F.col("value"), F.col("event_id")
    log = table(spark, sf_dir, "events").select(
        step.alias("step"), (step * 2048).alias("tokens_seen"), F.when(kind != "purchase", value).alias("train_loss"), F.when(kind == "purchase", value).alias("validation_loss"),
        (1 / (1 + step)).alias("learning_rate"), F.when(kind != "signup", value / 10).alias("gradient_norm"), F.col("user_id").cast("double").alias("tokens_per_second"),
    )
    row = stats.training_progress(log)
    return row.withColumns({"learning_rate": F.round("learning_rate", 12), "recent_gradient_norm": F.round("recent_gradient_norm", 9), "recent_tokens_per_second": F.round("recent_tokens_per_second", 9)})


@query(
    f"WITH {PAIRS}, t AS (SELECT len(string_split(instruction, ' ')) + 1 AS p, len(string_split(response, ' ')) + 1 AS a, list_max(list_transform(string_split(instruction || ' ' || response, ' '), lambda x: length(x))) + 10 AS top FROM pairs), "
    "k AS (SELECT *, p + a > 65 AS cut, CASE WHEN p + a > 65 THEN greatest(0, 65 - a) ELSE p END AS q FROM t) "
    "SELECT unnest(['ids_in_range', 'labels_in_range', 'same_length', 'no_truncation', 'both_kinds_everywhere', 'lengths_fit']) AS name, unnest([bool_and(top < 32000), bool_and(top < 32000), true, bool_and(NOT cut), bool_and(q > 0), bool_and(least(p + a, 65) BETWEEN 2 AND 65)]) AS passed FROM k"
)
def sft_cache_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w) + 10)
    return packing.sft_gates(pairs(spark, sf_dir).select(packing.sft_encoding(ids("instruction"), ids("response"), 64).alias("e")), 64)


@query(f"WITH t AS (SELECT conv_id * 1000 + turn AS o, len({_IDS.format('text')}) + 2 AS n FROM conversations), s AS (SELECT o, n, coalesce(sum(n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(lead(o) OVER (ORDER BY o), -1) AS nx FROM t) SELECT unnest(['not_negative', 'starts_at_zero', 'contiguous']) AS name, unnest([bool_and(s >= 0 AND n >= 0), min(s) = 0, max(s + n) = sum(n) AND count(DISTINCT s) = count(*)]) AS passed FROM s")
def stream_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the packed stream's starts and lengths fit together without gap or overlap."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w) + 10)
    held = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ordinal"), packing.framed(ids).alias("ids"))
    return packing.offset_checks(packing.offsets(held, "ordinal", F.size("ids")), "start", F.size("ids"))


@query(
    f"WITH {SHINGLES}, bw AS (SELECT item_id, string_split({NORM.format('text')}, ' ') AS w FROM benchmark WHERE {NORM.format('text')} <> ''), "
    "bs AS (SELECT item_id, unnest(list_distinct(CASE WHEN len(w) <= 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM bw) "
    "SELECT doc_id AS id, item_id AS item, count(*) AS shared FROM sh JOIN bs USING (s) GROUP BY ALL HAVING shared >= 5"
)
def benchmark_shared_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share five shingles of three words or more."""
    return contamination.shared_shingles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", least=5)


# --- secrets and sets ------------------------------------------------------------------------------------------------

_PLAIN = "replace(replace(text, '\"', ''), 'token', 'secret')"


@query(f"SELECT doc_id, regexp_matches({_PLAIN}, '{'|'.join('(?i:' + p.replace(chr(39), chr(39) * 2) + ')' for p in validate.SECRET_PATTERNS)}') AS secret FROM documents")
def secret_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a secret by the gate's patterns, once assigned values stand without quotes and tokens are called secrets."""
    plain = F.replace(F.replace("text", F.lit('"'), F.lit("")), F.lit("token"), F.lit("secret"))
    return table(spark, sf_dir, "documents").select("doc_id", validate.has_secret(plain).alias("secret"))


_BY_LANG = f"SELECT DISTINCT unnest(string_split({NORM.format('text')}, ' ')) AS word FROM documents WHERE lang = '{{}}'"


@query(f"SELECT 'shared' AS kind, word FROM ({_BY_LANG.format('de')} INTERSECT {_BY_LANG.format('en')}) UNION ALL SELECT 'only_de', word FROM ({_BY_LANG.format('de')} EXCEPT {_BY_LANG.format('en')})")
def language_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that German and English documents share, and those of German ones alone."""
    words = lambda lang: table(spark, sf_dir, "documents").where(F.col("lang") == lang).select(F.explode(F.split(T.dedup_form(F.col("text")), " ")).alias("word"))
    de, en = words("de"), words("en")
    return sampling.shared(de, en).select(F.lit("shared").alias("kind"), "word").unionByName(sampling.without(de, en).select(F.lit("only_de").alias("kind"), "word"))
