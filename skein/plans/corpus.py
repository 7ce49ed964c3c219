"""Corpus queries over documents and conversations: normalising, privacy, splits, text metrics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from skein.functions import fuzzy, privacy, text
from skein.operators import dedup, percentiles, splits
from skein.plans.registry import query, table
from skein.sources.scratch import write_table

# Fragments of the SQL that say the same as the functions.
_MARKS = f"'{text.MARKED}', '{text.PLAIN}'"
_PLAIN = "regexp_replace(translate(lower({0}), " + _MARKS + r"), '\p{{M}}+', '', 'g')"
_NORM = "trim(regexp_replace(replace(" + _PLAIN + r", 'ß', 'ss'), '[^\p{{L}}\p{{N}}:/._ -]+', ' ', 'g'))"
_CANON = "trim(regexp_replace(regexp_replace(" + _PLAIN + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_WORDS = "list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda w: w <> '')"
_DIGIT = "CAST(substr(x, {0}, 1) AS INT)"
_TOTAL = " + ".join(f"{_DIGIT.format(i + 1)} * {w}" for i, w in enumerate(privacy.CHECK_WEIGHTS))
_IDS = f"list_filter(regexp_extract_all(t1, '{privacy.LONG_ID}'), lambda x: CASE WHEN length(x) = 11 THEN (10 - ({_TOTAL}) % 10) % 10 = {_DIGIT.format(11)} ELSE false END)"
_TOPIC = {t: "(" + " OR ".join(f"contains(lower(t5), '{m}')" for m in marks) + ")" for t, marks in privacy.TOPICS.items()}
_REDACTED = f"""
r0 AS (SELECT *, coalesce(text, '') AS t0 FROM src),
r1 AS (SELECT *, regexp_replace(t0, '{privacy.SECRET}', '[SECRET]', 'g') AS t1 FROM r0),
r2 AS (SELECT *, {_IDS} AS ids FROM r1),
r3 AS (SELECT *, list_reduce(list_concat([t1], ids), lambda acc, x: replace(acc, x, '[ID]')) AS t2 FROM r2),
r4 AS (SELECT *, regexp_replace(t2, '{privacy.EMAIL}', '[EMAIL]', 'g') AS t3 FROM r3),
r5 AS (SELECT *, regexp_replace(t3, '{privacy.PHONE}', '[PHONE]', 'g') AS t4 FROM r4),
r6 AS (SELECT *, regexp_replace(t4, '{privacy.URL}', '[URL]', 'g') AS t5 FROM r5),
redacted AS (SELECT *, trim(regexp_replace(t5, '[ \\t]+', ' ', 'g')) AS clean,
  list_filter([CASE WHEN regexp_matches(t0, '{privacy.SECRET}') THEN 'secret' END, CASE WHEN len(ids) > 0 THEN 'checksum_id' END,
   CASE WHEN regexp_matches(t2, '{privacy.EMAIL}') THEN 'email' END, CASE WHEN regexp_matches(t3, '{privacy.PHONE}') THEN 'phone' END,
   CASE WHEN regexp_matches(t4, '{privacy.URL}') THEN 'url' END, {', '.join(f"CASE WHEN {c} THEN '{t}' END" for t, c in _TOPIC.items())}], lambda x: x IS NOT NULL) AS flags FROM r6)"""
_REASON = "CASE WHEN coalesce(speaker, 'unknown') <> 'self' THEN 'speaker' WHEN trim(clean) = '' THEN 'empty' WHEN list_has_any(flags, ['health', 'finance', 'legal']) THEN 'sensitive_topic' WHEN list_contains(flags, 'checksum_id') OR list_contains(flags, 'secret') THEN 'high_risk_id' END"
_SPEAKER = "CASE WHEN lang = 'en' THEN 'self' WHEN lang = 'fr' THEN 'self' ELSE 'other' END"
_SPLIT = "CASE WHEN ('0x' || substr(sha256({0}), 1, 8))::BIGINT % 100 < 20 THEN 'holdout' ELSE 'train' END"


def _speaker() -> Column:
    """The local stand-in for speakers: two languages are the owner's own."""
    return F.when(F.col("lang").isin("en", "fr"), F.lit("self")).otherwise(F.lit("other"))


@query(f"""
WITH firsts AS (
  SELECT *, row_number() OVER (PARTITION BY sha256({_NORM.format('text')}) ORDER BY doc_id) AS nth FROM documents),
src AS (SELECT *, {_SPEAKER} AS speaker FROM firsts WHERE nth = 1), {_REDACTED},
gated AS (SELECT *, {_REASON} AS reason FROM redacted)
SELECT CASE WHEN reason IS NOT NULL THEN 'unused' ELSE {_SPLIT.format('source')} END AS split, count(*) AS n_rows,
  CAST(sum(len({_WORDS.format('clean')})) AS BIGINT) AS n_words, CAST(sum(CASE WHEN len(flags) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_redacted,
  CAST(sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_quarantined
FROM gated GROUP BY 1""")
def corpus_summary(spark, sf_dir):
    """The corpus run: normalise, keep first copies, redact and quarantine, split by session, count."""
    firsts = dedup.first_of_each(table(spark, sf_dir, "documents", spread=True), F.sha2(text.normalize(F.col("text")), 256), "doc_id")
    rows = privacy.redacted(firsts.withColumn("speaker", _speaker()))
    rows = rows.withColumn("reason", privacy.quarantine_reason(F.col("speaker"), F.col("clean"), F.col("flags")))
    split = F.when(F.col("reason").isNotNull(), F.lit("unused")).otherwise(splits.hash_split(F.col("source")))
    return rows.groupBy(split.alias("split")).agg(
        F.count("*").alias("n_rows"), F.sum(text.word_count(F.col("clean"))).alias("n_words"), F.count_if(F.size("flags") > 0).alias("n_redacted"), F.count_if(F.col("reason").isNotNull()).alias("n_quarantined")
    )


@query(f"""SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256({_NORM.format('text')}) ORDER BY doc_id) AS first_id FROM documents""")
def exact_dedup_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", F.sha2(text.normalize(F.col("text")), 256).alias("h"))
    return dedup.with_first_id(write_table(docs, "hashes"), "h", "doc_id").select("doc_id", "first_id")


@query(f"SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, {_SPLIT.format('CAST(conv_id AS VARCHAR)')} AS split FROM conversations GROUP BY conv_id")
def hash_split_by_session(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return turns.withColumn("split", splits.hash_split(F.col("conv_id").cast("string")))


@query(f"WITH src AS (SELECT * FROM documents), {_REDACTED} SELECT flag, count(*) AS n_docs FROM (SELECT unnest(flags) AS flag FROM redacted) GROUP BY flag")
def pii_flag_counts(spark, sf_dir):
    # explode() would add a filter on the flags, and with it compute them twice.
    flags = privacy.redacted(table(spark, sf_dir, "documents")).select(F.explode_outer("flags").alias("flag"))
    return flags.where("flag is not null").groupBy("flag").agg(F.count("*").alias("n_docs"))


@query(f"WITH src AS (SELECT *, {_SPEAKER} AS speaker FROM documents), {_REDACTED} SELECT coalesce({_REASON}, 'clean') AS reason, count(*) AS n_docs, CAST(sum(length(clean)) AS BIGINT) AS n_chars FROM redacted GROUP BY 1")
def quarantine_reasons(spark, sf_dir):
    rows = privacy.redacted(table(spark, sf_dir, "documents", spread=True).withColumn("speaker", _speaker()))
    reason = F.coalesce(privacy.quarantine_reason(F.col("speaker"), F.col("clean"), F.col("flags")), F.lit("clean"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_docs"), F.sum(F.length("clean")).alias("n_chars"))


@query(f"WITH src AS (SELECT * FROM documents), {_REDACTED} SELECT doc_id, sha256(clean) AS clean_sha256, array_to_string(flags, ',') AS flags FROM redacted")
def redacted_texts(spark, sf_dir):
    """The redaction itself, as a digest of every document's clean text."""
    rows = privacy.redacted(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.array_join("flags", ",").alias("flags"))


@query(f"""
WITH t AS (SELECT role, text, CAST(len({_WORDS.format('text')}) AS DOUBLE) AS n FROM conversations WHERE role <> 'system' AND trim(text) <> '')
SELECT role, count(*) AS n_rows, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q75,
  round(avg(CASE WHEN contains(text, '?') THEN 1.0 ELSE 0.0 END), 6) AS question_share, round(avg(length(text)), 6) AS mean_chars,
  CASE WHEN quantile_cont(n, 0.5) < 12 THEN 'short' WHEN quantile_cont(n, 0.5) < 60 THEN 'medium' ELSE 'long' END AS band
FROM t GROUP BY role""")
def style_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'system' and trim(text) <> ''").withColumn("n", text.word_count(F.col("text")).cast("double"))
    found = percentiles.linear(rows, "role", "n", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    median = F.col("median")
    band = F.when(median < 12, F.lit("short")).when(median < 60, F.lit("medium")).otherwise(F.lit("long"))
    shares = rows.groupBy("role").agg(F.count("*").alias("n_rows"), F.round(F.avg(F.contains("text", F.lit("?")).cast("double")), 6).alias("question_share"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
    return shares.join(found.select("role", *[F.round(c, 6).alias(c) for c in ("q25", "median", "q75")], band.alias("band")), "role")


_PAIRS = """
pairs AS (
  SELECT conv_id, turn, {0} AS a, {1} AS b FROM (
    SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) WHERE next_text IS NOT NULL)"""


def _adjacent(spark, sf_dir):
    """Each turn beside the next of its conversation: the stand-in for reference and hypothesis."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("next_text", F.lead("text").over(w)).where("next_text is not null")


@query()
def cer_adjacent_turns(spark, sf_dir):
    """Over whole texts, code point by code point."""
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(text.character_error_rate(F.col("text"), F.col("next_text")), 6).alias("cer"))


@query()
def wer_adjacent_turns(spark, sf_dir):
    """Over whole texts, word by word."""
    rows = _adjacent(spark, sf_dir).where(text.word_count(F.col("text")) > 0)
    return rows.select("conv_id", "turn", F.round(text.word_error_rate(F.col("text"), F.col("next_text")), 6).alias("wer"))


@query()
def error_rates_of_corpus(spark, sf_dir):
    """Mean CER and WER of all adjacent turns."""
    rates = _adjacent(spark, sf_dir).select(text.character_error_rate(F.col("text"), F.col("next_text")).alias("cer"), text.word_error_rate(F.col("text"), F.col("next_text")).alias("wer"))
    return rates.agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("cer"), F.round(F.avg("wer"), 6).alias("wer"))


_N = lambda c, m: f"(length({c}) - length(replace({c}, '{m}', '')))"
_SAME = " + ".join(f"least({_N('a', m)}, {_N('b', m)})" for m in text.PUNCTUATION)
_ALL = " + ".join(f"{_N(c, m)}" for m in text.PUNCTUATION for c in "ab")


@query(f"WITH {_PAIRS.format('text', 'next_text')} SELECT conv_id, turn, round(CASE WHEN {_ALL} = 0 THEN 1.0 ELSE 2.0 * ({_SAME}) / ({_ALL}) END, 6) AS f1 FROM pairs")
def punctuation_f1(spark, sf_dir):
    return _adjacent(spark, sf_dir).select("conv_id", "turn", F.round(text.punctuation_f1(F.col("text"), F.col("next_text")), 6).alias("f1"))


# Our own marker words, in the languages of the tables.
CANCEL, ASK, DO = ["cancel", "stop it", "annule"], ["?", "what", "pourquoi", "warum", "por que"], ["open", "send", "ouvre", "mach", "abre"]
_HAS = lambda ms: "(" + " OR ".join(f"contains(lower(text), '{m}')" for m in ms) + ")"
_INTENT = f"CASE WHEN trim(text) = '' THEN 'ambiguous' WHEN {_HAS(CANCEL)} THEN 'cancellation' WHEN {_HAS(ASK)} THEN 'question' WHEN {_HAS(DO)} THEN 'task' ELSE 'conversation' END"
_SURE = "CASE {0} WHEN 'cancellation' THEN 0.95 WHEN 'question' THEN 0.9 WHEN 'task' THEN 0.85 WHEN 'conversation' THEN 0.65 ELSE 0.0 END"


def _has(markers: list[str]) -> Column:
    return text.keyword_hits(F.lower("text"), markers) > 0


def intent() -> Column:
    return F.when(F.trim("text") == "", F.lit("ambiguous")).when(_has(CANCEL), F.lit("cancellation")).when(_has(ASK), F.lit("question")).when(_has(DO), F.lit("task")).otherwise(F.lit("conversation"))


def confidence(label: Column) -> Column:
    return F.when(label == "cancellation", 0.95).when(label == "question", 0.9).when(label == "task", 0.85).when(label == "conversation", 0.65).otherwise(0.0)


@query(f"SELECT {_INTENT} AS intent, count(*) AS n, round(avg({_SURE.format('(' + _INTENT + ')')}), 6) AS confidence FROM conversations GROUP BY 1")
def intent_keyword_class(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("intent", intent())
    return rows.groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg(confidence(F.col("intent"))), 6).alias("confidence"))


@query(f"""
WITH votes AS (
  SELECT conv_id, turn, unnest([{{'label': {_INTENT}, 'w': 0.35}}, {{'label': CASE WHEN role = 'user' THEN 'task' ELSE 'conversation' END, 'w': 0.30}},
    {{'label': CASE WHEN length(text) % 3 = 0 THEN 'question' ELSE 'conversation' END, 'w': 0.35}}]) AS v FROM conversations),
s AS (SELECT conv_id, turn, v.label AS label, round(CAST(sum(v.w) AS DOUBLE), 6) AS score FROM votes GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, label) AS nth FROM s)
SELECT conv_id, turn, label, score FROM r WHERE nth = 1""")
def intent_fusion(spark, sf_dir):
    """Three weighted voters; the label of the highest sum wins, ties by name."""
    vote = lambda label, w: F.struct(label.alias("label"), F.lit(w).alias("w"))
    by_role = F.when(F.col("role") == "user", F.lit("task")).otherwise(F.lit("conversation"))
    by_length = F.when(F.length("text") % 3 == 0, F.lit("question")).otherwise(F.lit("conversation"))
    votes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(vote(intent(), 0.35), vote(by_role, 0.30), vote(by_length, 0.35))).alias("v"))
    sums = votes.groupBy("conv_id", "turn", F.col("v.label").alias("label")).agg(F.round(F.sum("v.w"), 6).alias("score"))
    best = sums.groupBy("conv_id", "turn").agg(F.min(F.struct((-F.col("score")).alias("s"), "label", "score")).alias("x"))
    return best.select("conv_id", "turn", "x.label", "x.score")


@query(f"""
SELECT tag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN {_HAS(ASK)} THEN 'question' END, CASE WHEN {_HAS(DO)} THEN 'task' END, CASE WHEN {_HAS(CANCEL)} THEN 'cancellation' END,
  CASE WHEN contains(text, chr(10)) THEN 'compound' END, CASE WHEN length(text) < 80 THEN 'short' END], lambda x: x IS NOT NULL)) AS tag FROM conversations) GROUP BY tag""")
def tag_counts(spark, sf_dir):
    tags = F.array_compact(F.array(F.when(_has(ASK), F.lit("question")), F.when(_has(DO), F.lit("task")), F.when(_has(CANCEL), F.lit("cancellation")), F.when(F.contains("text", F.lit("\n")), F.lit("compound")), F.when(F.length("text") < 80, F.lit("short"))))
    return table(spark, sf_dir, "conversations").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


# Journal markers, our own: a category wins by hits, ties by order.
JOURNAL = {"decision": ["the and", "est "], "task": ["of ", "des "], "risk": ["that ", "das "]}
_HITS = {c: " + ".join(f"CAST(contains(lower(text), '{m}') AS INT)" for m in ms) for c, ms in JOURNAL.items()}


@query(f"""
WITH h AS (SELECT doc_id, unnest([{', '.join(f"{{'at': {i}, 'category': '{c}', 'n': {_HITS[c]}}}" for i, c in enumerate(JOURNAL))}]) AS x FROM documents WHERE NOT contains(text, '?')),
r AS (SELECT doc_id, x.category AS category, x.n AS n, row_number() OVER (PARTITION BY doc_id ORDER BY x.n DESC, x.at) AS nth FROM h WHERE x.n > 0)
SELECT doc_id, category, round(least(0.95, 0.70 + 0.08 * (n - 1)), 6) AS confidence FROM r WHERE nth = 1""")
def journal_candidates(spark, sf_dir):
    hit = lambda i, c: F.struct((-text.keyword_hits(F.lower("text"), JOURNAL[c])).alias("n"), F.lit(i).alias("at"), F.lit(c).alias("category"))
    best = F.array_min(F.array(*[hit(i, c) for i, c in enumerate(JOURNAL)]))
    rows = table(spark, sf_dir, "documents").where(~F.contains("text", F.lit("?"))).select("doc_id", best.alias("x")).where("x.n < 0")
    return rows.select("doc_id", "x.category", F.round(F.least(F.lit(0.95), 0.70 + 0.08 * (-F.col("x.n") - 1)), 6).cast("double").alias("confidence"))


@query(f"""
WITH k AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[.] (The|La|Le|Die|El) ') THEN 'preference' WHEN regexp_matches(text, ' (is|est|ist|es) ') THEN 'fact' END AS kind, {_NORM.format('text')} AS norm FROM documents)
SELECT kind, substr(sha256(kind || ':' || norm), 1, 24) AS candidate_id, min(doc_id) AS first_doc, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def memory_candidates(spark, sf_dir):
    kind = F.when(F.col("text").rlike("[.] (The|La|Le|Die|El) "), F.lit("preference")).when(F.col("text").rlike(" (is|est|ist|es) "), F.lit("fact"))
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), text.normalize(F.col("text")).alias("norm")).where("kind is not null")
    ids = F.substring(F.sha2(F.concat("kind", F.lit(":"), "norm"), 256), 1, 24)
    return rows.groupBy("kind", ids.alias("candidate_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query(f"""
WITH s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS sh
  FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents) WHERE len(w) >= 5),
firsts AS (SELECT min(doc_id) AS doc_id, any_value(sh) AS sh FROM s GROUP BY list_sort(sh)),
e AS (SELECT doc_id, unnest(sh) AS g, len(sh) AS n FROM firsts),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS jaccard FROM p WHERE c / (na + nb - c)::DOUBLE >= 0.88""")
def shingle_jaccard_pairs(spark, sf_dir):
    """Pairs of a five-word shingle similarity of 0.88 or more; copies are represented by their first."""
    docs = table(spark, sf_dir, "documents", spread=True).select(F.col("doc_id").alias("id"), text.shingle_hashes(F.col("text")).alias("tokens"))
    return dedup.similar_pairs(docs, 0.88).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
WITH sh AS (SELECT 'd' AS side, doc_id AS id, {_WORDS.format('text')} AS w FROM documents UNION ALL SELECT 'b', item_id, {_WORDS.format('text')} FROM benchmark),
g AS (SELECT side, id, unnest(list_distinct(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' ')))) AS g FROM sh WHERE len(w) >= 13)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM g d JOIN g b ON d.side = 'd' AND b.side = 'b' AND d.g = b.g GROUP BY 1, 2""")
def benchmark_overlap(spark, sf_dir):
    """Runs of 13 words that a document shares with a benchmark item."""
    return dedup.shared_runs(table(spark, sf_dir, "documents", spread=True), "doc_id", table(spark, sf_dir, "benchmark"), "item_id", "text", 13)


@query(f"""
SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host,
  CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*[.]internal') THEN 'deny' WHEN ends_with(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.org') THEN 'allow'
       WHEN ends_with(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.com') THEN 'allow' ELSE 'deny_default' END AS verdict FROM pages""")
def host_policy(spark, sf_dir):
    """An ordered chain of host rules; the first that matches decides."""
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1), F.lit(""))
    verdict = F.when(F.col("url").rlike("^[a-z]+://[^/]*[.]internal"), F.lit("deny")).when(F.endswith(host, F.lit(".org")), F.lit("allow")).when(F.endswith(host, F.lit(".com")), F.lit("allow")).otherwise(F.lit("deny_default"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), verdict.alias("verdict"))


@query(f"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS body FROM pages),
l AS (SELECT page_id, list_distinct(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'))), lambda x: length(x) > 2)) AS lines FROM t)
SELECT page_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM l""")
def page_cleanup(spark, sf_dir):
    """Tag blocks stripped, spaces collapsed, tiny and repeated lines dropped."""
    plain = F.regexp_replace(F.regexp_replace("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " ")
    lines = F.array_distinct(F.filter(F.transform(F.split(plain, "\n"), text.collapse), lambda x: F.length(x) > 2))
    return table(spark, sf_dir, "pages").select("page_id", lines.alias("lines")).select("page_id", F.size("lines").cast("long").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("n_chars"))


@query(f"SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, count(DISTINCT sha256(text)) AS n_texts, {text.set_fingerprint_sql("(doc_id || ':' || sha256(text))")} AS fingerprint FROM documents GROUP BY source")
def source_manifest(spark, sf_dir):
    """Totals and a fingerprint of each source's documents; sums of hashes, so no task holds a source."""
    rows = table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256))
    entry = F.concat(F.col("doc_id").cast("string"), F.lit(":"), "h")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.count_distinct("h").alias("n_texts"), text.set_fingerprint(entry).alias("fingerprint"))


@query(f"""
SELECT doc_id, len({_WORDS.format('text')}) > 500 OR contains(lower(text), 'def ') OR contains(text, '{{') OR
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[|]|!!|[*][*]'))) >= 0.35 * len(string_split(text, chr(10))) AS technical FROM documents""")
def technical_texts(spark, sf_dir):
    """Long or structured texts, which the corpus leaves out."""
    lines = F.split("text", "\n")
    structured = F.size(F.filter(lines, lambda x: x.rlike("[|]|!!|[*][*]"))) >= 0.35 * F.size(lines)
    return table(spark, sf_dir, "documents").select("doc_id", ((text.word_count(F.col("text")) > 500) | F.contains(F.lower("text"), F.lit("def ")) | F.contains("text", F.lit("{")) | structured).alias("technical"))


@query()
def greedy_near_dedup(spark, sf_dir):
    """First come, first kept: a document goes if a kept earlier one is similar or equal; near copies keep nobody out."""
    docs = table(spark, sf_dir, "documents", spread=True).select(F.col("doc_id").alias("id"), "text", text.shingle_hashes(F.col("text")).alias("tokens"))
    sets = dedup.token_sets(docs)
    return dedup.greedy_keepers(sets.select("id"), dedup.similar_pairs(sets, 0.88), write_table(dedup.representatives(sets), "firsts"))


@query()
def short_near_dedup(spark, sf_dir):
    """Texts of at most five words: a shared token, token Jaccard of 0.6 and a character ratio of 0.82; copies beside their first."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.canonical(F.col("text")).alias("text")).where(text.word_count(F.col("text")).between(1, 5))
    return dedup.similar_short_texts(rows, 0.6, 0.82)


@query()
def echo_scores(spark, sf_dir):
    """How much of each turn echoes the one before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("spoken", F.lag("text").over(w)).where("spoken is not null")
    return turns.select("conv_id", "turn", F.round(fuzzy.echo_score("text", "spoken"), 6).alias("echo"))


# Our own variants of frequent words.
LEXICON = {"the": "THE", "of the": "OF-THE", "les": "LES"}


@query()
def lexicon_replace(spark, sf_dir):
    """Approved forms for whole words of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(fuzzy.lexicon_replace(F.col("text"), LEXICON), 256).alias("replaced_sha256"))
