"""Redaction and quarantine of personal data, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Our own patterns, written so that Java and RE2 read them alike.
SECRET = r"(AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{30,}|(password|api[_-]?key|token)[=:][^ \n]+)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
PHONE = r"[+]?[(]?[0-9]{1,4}[)]?[ -][(0-9][0-9() -]{5,}[0-9]"
URL = r"https?://[^ \n\t]+"
LONG_ID = r"[0-9]{11,}"
CHECK_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
TOPICS = {"health": ["diagnosis", "medication", "therapy"], "finance": ["salary", "bank account", "loan"], "legal": ["lawsuit", "court order"]}

#: What a text must hold, one of them, for a pattern to be found: a plain search, and most texts need no more.
HOLDS = {SECRET: ("AKIA", "sk-", "ghp_", "password", "api", "token"), EMAIL: ("@",), URL: ("://",)}
#: The same for Java, which otherwise gives back a word's characters one by one, though none is an @.
_QUICK = {EMAIL: EMAIL.replace("]+@", "]++@")}


def _may_hold(text: Column, pattern: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in HOLDS[pattern]])


def _has(text: Column, pattern: str) -> Column:
    return _may_hold(text, pattern) & text.rlike(_QUICK.get(pattern, pattern))


def _without(text: Column, pattern: str, mark: str) -> Column:
    return F.when(_may_hold(text, pattern), F.regexp_replace(text, _QUICK.get(pattern, pattern), mark)).otherwise(text)


def checksum_ids(text: Column) -> Column:
    """The runs of exactly 11 digits whose last digit closes the weighted sum of the others."""

    def valid(x: Column) -> Column:
        digits = [F.substring(x, i + 1, 1).cast("int") for i in range(11)]
        total = sum((d * w for d, w in zip(digits, CHECK_WEIGHTS)), F.lit(0))
        return F.when(F.length(x) == 11, (F.lit(10) - total % 10) % 10 == digits[10]).otherwise(F.lit(False))

    return F.filter(F.regexp_extract_all(text, F.lit(LONG_ID), F.lit(0)), valid)


def redacted(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds clean and flags: secrets, checksum ids, e-mails, phones and URLs replaced in this order, each kind flagged once, then topics."""
    flags = [F.when(_has(F.col("_t0"), SECRET), F.lit("secret"))]
    rows = rows.withColumn("_t0", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_t1", _without(F.col("_t0"), SECRET, "[SECRET]")).withColumn("_ids", checksum_ids(F.col("_t1")))
    rows = rows.withColumn("_t2", F.aggregate("_ids", F.col("_t1"), lambda t, x: F.replace(t, x, F.lit("[ID]"))))
    rows = rows.withColumn("_t3", _without(F.col("_t2"), EMAIL, "[EMAIL]")).withColumn("_t4", F.regexp_replace("_t3", PHONE, "[PHONE]")).withColumn("_t5", _without(F.col("_t4"), URL, "[URL]"))
    # A phone's digits go, so a text that holds one is another afterwards.
    flags += [F.when(F.size("_ids") > 0, F.lit("checksum_id")), F.when(_has(F.col("_t2"), EMAIL), F.lit("email")), F.when(F.col("_t4") != F.col("_t3"), F.lit("phone")), F.when(_has(F.col("_t4"), URL), F.lit("url"))]
    for topic, marks in TOPICS.items():
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(F.lower("_t5"), F.lit(m))
        flags.append(F.when(hit, F.lit(topic)))
    clean = F.trim(F.regexp_replace("_t5", r"[ \t]+", " "))
    return rows.withColumn("clean", clean).withColumn("flags", F.array_compact(F.array(*flags))).drop("_ids", *[f"_t{i}" for i in range(6)])


def quarantine_reason(speaker: Column, clean: Column, flags: Column) -> Column:
    """The first that holds: another speaker, no text, a sensitive topic, a high-risk id; null if the row may stay."""
    topics = F.array(*[F.lit(t) for t in TOPICS])
    return (
        F.when(F.coalesce(speaker, F.lit("unknown")) != "self", F.lit("speaker"))
        .when(F.trim(clean) == "", F.lit("empty"))
        .when(F.arrays_overlap(flags, topics), F.lit("sensitive_topic"))
        .when(F.array_contains(flags, "checksum_id") | F.array_contains(flags, "secret"), F.lit("high_risk_id"))
    )


def gate(rows: DataFrame, speaker: str) -> tuple[DataFrame, DataFrame]:
    """(clean rows with the redacted text, quarantined rows without any text)."""
    marked = redacted(rows).withColumn("reason", quarantine_reason(F.col(speaker), F.col("clean"), F.col("flags")))
    kept = marked.where("reason is null").withColumn("text", F.col("clean")).drop("clean", "reason")
    return kept, marked.where("reason is not null").drop("text", "clean")
