"""Choosing rows so that every tag gets its quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_by_coverage(rows: DataFrame, id: str, tags: str, quotas: dict[str, int], target: int, scarce: str | None = None) -> DataFrame:
    """(rank, id, gain): the first ``target`` rows of a greedy choice.

    Each step takes the row whose tags lack most to their quotas; of those the one whose tags were taken
    least; of those the one of the greatest id. Rows with the tag ``scarce`` come after all others once its
    quota is full. gain is what the row's tags lacked. Tags without a quota don't count.

    Rows with the same tags differ in their ids alone, so the choice is made over the sets of tags that
    occur (at most two to the number of quotas), each with as many rows as it has, up to target; then every set's
    rows are taken in the order of their ids. Fewer rows than ``target``: all. Null or empty tags: last.
    """
    known = F.array(*[F.lit(t) for t in sorted(quotas)])
    tagged = rows.select(F.col(id).alias("id"), F.coalesce(F.array_join(F.array_sort(F.array_intersect(F.array_distinct(F.col(tags)), known)), ","), F.lit("")).alias("set"))
    most = tagged.groupBy("set").agg(F.least(F.count("*"), F.lit(target)).alias("n")).collect()
    # Ids decide between sets too: the ids that each set could still give, greatest first.
    best = Window.partitionBy("set").orderBy(F.desc("id"))
    given = tagged.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= target)
    left = {r.set: r.n for r in most}
    taken = dict.fromkeys(quotas, 0)
    ids: dict[str, list] = {}
    for r in given.orderBy("set", "nth").select("set", "id").toLocalIterator():  # target rows a set at most
        ids.setdefault(r.set, []).append(r.id)
    chosen = []
    while len(chosen) < target and left:
        def worth(s: str) -> tuple:
            own = [t for t in s.split(",") if t]
            lack = sum(max(0, quotas[t] - taken[t]) for t in own)
            late = scarce in own and taken[scarce] >= quotas[scarce]
            return (not late, lack, -sum(taken[t] for t in own), ids[s][len(ids[s]) - left[s]])

        s = max(left, key=worth)
        gain, next_id = worth(s)[1], ids[s][len(ids[s]) - left[s]]
        chosen.append((len(chosen) + 1, next_id, gain))
        left[s] -= 1
        if not left[s]:
            del left[s]
        for t in s.split(","):
            if t:
                taken[t] += 1
    kind = dict(rows.dtypes)[id]
    return rows.sparkSession.createDataFrame(chosen, f"rank int, id {kind}, gain long")
