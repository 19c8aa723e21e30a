"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A document's expected number of copies is its source's
target over its source's size: the whole part is taken for certain, and the fraction is the
inclusion probability of one more copy.  That copy is drawn by Pareto order sampling: documents
are ranked by their random odds ``u / (1 - u)`` divided by their inclusion odds ``p / (1 - p)``,
and those that fit the words still due are taken in that order: one that would overflow them is
passed over.  When none fits any more, the document that comes nearest to what is due is added, if that helps.

Only numbers are shuffled: a source's ranking is cut where running totals overflow, found distributed
(a hot source is spread over many tasks), then the later documents that still fit are ranked again, until
none does.  What is taken is a predicate on the documents, with one condition for each turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.llm.common import fresh, unit, word_count
from playtrail.operators.ordering import positions
from playtrail.scratch import through_table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)

_NO_ID = -(2**63)
_PLACE = "struct<q:double,id:bigint,size:bigint>"
_TURN = f"struct<after:{_PLACE},upto:{_PLACE},most:double>"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """Targets of the sources: (source, source_no, source_size, target).

    ``sizes`` has (source, size) rows.  Sources in code-point order, null last, weigh ``weights``,
    repeating, and share ``share`` times all sizes.  A target stops at ``max_copies`` times its
    source's size; the excess goes to the others by weight until no target is above its limit.
    An empty table gives no rows; sources of size 0 get the target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    numbered = through_table(
        positions(totals, [F.asc_nulls_last("source")], name="source_no").withColumn(
            "weight",
            F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") - 1).cast("int") % len(weights) + 1
            ),
        ),
        "sources",
    )
    cap = F.col("source_size") * float(max_copies)
    by_ratio = through_table(
        positions(
            numbered.withColumn("cap", cap),
            [F.asc(F.col("cap") / F.col("weight")), F.asc("source_no")],
            name="place",
            sums={"caps": "cap", "weights": "weight"},
        ),
        "source_places",
    )
    whole = by_ratio.agg(F.sum("source_size"), F.sum("weight")).first()
    # Sources come in the order in which they reach their limits; the first that stays below
    # its share of what the earlier ones left is the first without a limit.
    due = F.lit(float(share) * float(whole[0] or 0)) - (F.col("caps") - F.col("cap"))
    rest = F.lit(float(whole[1] or 0)) - (F.col("weights") - F.col("weight"))
    free = (
        by_ratio.where(due * F.col("weight") / rest <= F.col("cap"))
        .agg(F.min_by(F.struct("place", due.alias("due"), rest.alias("rest")), "place").alias("free"))
        .first()["free"]
    )
    if free is None:
        target = F.col("cap")
    else:
        target = F.when(F.col("place") < free["place"], F.col("cap")).otherwise(
            F.least(F.col("cap"), F.lit(free["due"]) * F.col("weight") / F.lit(free["rest"]))
        )
    return by_ratio.select("source", "source_no", "source_size", target.alias("target"))


def _odds(p: Column) -> Column:
    """Null for certain or impossible events."""
    return F.when((p > 0) & (p < 1), p / (1 - p))


def sampling_plan(light: DataFrame, targets: DataFrame, seed: int = 11, finishing: bool = True) -> DataFrame:
    """What each source takes: whole copies, the cut of its ranking and what is taken after it.

    ``light`` has (source, doc_id, size[, odds]); equal rows share their fate.  ``odds`` multiplies
    a document's inclusion odds (1 where null or absent), which makes probabilities unequal
    within a source as well.  The cut is where the ranking first overflows what is due.  With ``finishing``, the document
    there is passed over and those after it that fit what is still due follow in their order, turn by turn until
    none fits; ``turns`` has each turn's ranks and greatest words.  At last ``extra`` is the document
    that comes nearest to what is due, if it brings the source nearer to it.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("copies", F.floor(ratio).cast("bigint")).withColumn("p", ratio - F.floor(ratio))
    plan = through_table(plan, "mix_plan")
    groups = light.groupBy("source", "doc_id", "size", "odds").agg(F.count(F.lit(1)).alias("n"))
    drawn = groups.join(
        plan.where("p > 0").select(F.col("source").alias("_s"), "source_no", "p"), F.col("source").eqNullSafe(F.col("_s"))
    ).select(
        "source_no",
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"),
        "size",
        (F.col("size") * F.col("n")).alias("words"),
        pareto_rank(F.col("doc_id"), F.col("p"), F.col("odds"), seed).alias("q"),
    )
    order, me = [F.asc("q"), F.asc("id"), F.asc("size")], F.struct("q", "id", "size")
    due = F.col("target") - F.col("copies") * F.col("source_size")
    state = through_table(
        plan.withColumn("gap", due)
        .withColumn("cut", F.lit(None).cast(_PLACE))
        .withColumn("passed", F.lit(None).cast(_PLACE))
        .withColumn("turns", F.expr(f"cast(array() as array<{_TURN}>)"))
        .withColumn("extra", F.lit(None).cast(_PLACE)),
        "mix_state",
    )
    left = drawn
    while True:
        # What one source has left is what lies behind the document passed over and fits.
        reached = through_table(positions(left, order, keys=["source_no"], sums={"reached": "words"}), "mix_ranking")
        ranking = reached if left is drawn else ranking
        ends = (
            reached.join(state.select("source_no", "gap"), "source_no")
            .withColumn("fits", F.col("reached") <= F.col("gap"))
            .groupBy("source_no")
            .agg(
                F.max(F.when(F.col("fits"), me)).alias("upto"),
                F.max(F.when(F.col("fits"), F.col("reached"))).alias("words"),
                F.min(F.when(~F.col("fits"), me)).alias("over"),
            )
        )
        first = left is drawn
        turn = F.struct(F.col("passed").alias("after"), "upto", F.col("gap").alias("most"))
        state = through_table(
            state.join(ends, "source_no", "left")
            .withColumn("cut", F.col("upto") if first else F.col("cut"))
            .withColumn("turns", F.col("turns") if first else F.when(F.col("upto").isNull(), F.col("turns")).otherwise(F.concat("turns", F.array(turn))))
            .withColumn("gap", F.col("gap") - F.coalesce("words", F.lit(0)))
            .withColumn("passed", F.col("over"))
            .drop("upto", "words", "over"),
            "mix_state",
        )
        if not finishing:
            return state
        passed = state.where("gap > 0 and passed is not null").select("source_no", "passed", "gap")
        left = (
            reached.drop("reached").join(passed, "source_no")
            .where((me > F.col("passed")) & (F.col("words") > 0) & (F.col("words") <= F.col("gap")))
            .select(*drawn.columns)
        )
        if left.isEmpty():
            break
    miss = F.abs(F.col("words") - F.col("gap"))
    nearest = (
        ranking.join(state.where("gap > 0").select("source_no", "cut", "turns", "gap"), "source_no")
        .where(~_taken(me, F.col("words"), F.col("cut"), F.col("turns")) & (miss < F.col("gap")))
        .groupBy("source_no")
        .agg(F.min_by(me, F.struct(miss, "q", "id", "size")).alias("add"))
    )
    return through_table(
        state.join(nearest, "source_no", "left").withColumn("extra", F.col("add")).drop("add", "passed"), "mix_state"
    )


def _taken(me: Column, words: Column, cut: Column, turns: Column) -> Column:
    """Whether a place of the ranking is before the cut or was taken in a later turn."""
    later = F.exists(turns, lambda t: (me > t["after"]) & (me <= t["upto"]) & (words > 0) & (words <= t["most"]))
    return F.coalesce(me <= cut, F.lit(False)) | later


def pareto_rank(doc_id: Column, p: Column, odds: Column, seed: int) -> Column:
    """Random odds over inclusion odds; null where nothing is drawn."""
    return _odds(unit(seed, doc_id)) / (_odds(p) * F.coalesce(odds, F.lit(1.0)))


def copies_taken(plan_p: Column, copies: Column, cut: Column, turns: Column, extra: Column, rank: Column, doc_id: Column, size: Column, words: Column) -> Column:
    """Copies of a document under its source's plan; ``words`` counts those of its repeated rows too."""
    me = F.struct(rank.alias("q"), F.coalesce(doc_id, F.lit(_NO_ID)).alias("id"), size.alias("size"))
    more = (plan_p > 0) & (_taken(me, words, cut, turns) | F.coalesce(me == extra, F.lit(False)))
    return copies + F.when(more, 1).otherwise(0)


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = 1.5,
    max_copies: int = 2,
    seed: int = 11,
    odds: str | None = None,
) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``docs`` with what the mix takes of each, and the names of the added columns.

    Added: size (words of the text, 0 for null), source_size, target, copies, taken (copies times
    size); a name that ``docs`` has already is lengthened by underscores, as the returned
    dictionary says.  Reads ``doc_id``, ``text`` and ``source``.  A null source is a source; null ids and
    repeated rows share one draw; an empty table gives an empty one.  Reruns draw the same.
    """
    given = F.col(odds).cast("double") if odds else F.lit(None).cast("double")
    light = through_table(
        docs.select("source", "doc_id", word_count(F.col("text")).alias("size"), given.alias("odds")), "mix_sizes"
    )
    plan = sampling_plan(light, source_targets(light, weights, share, max_copies), seed)
    names = ["size", "source_size", "target", "copies", "taken"]
    out = dict(zip(names, fresh(docs, *names), strict=True))
    src, p, cut, turns, extra, n = fresh(docs, "_src", "_p", "_cut", "_turns", "_extra", "_n")
    per_source = plan.select(
        F.col("source").alias(src),
        F.col("source_size").alias(out["source_size"]),
        F.col("target").alias(out["target"]),
        F.col("copies").alias(out["copies"]),
        F.col("p").alias(p),
        F.col("cut").alias(cut),
        F.col("turns").alias(turns),
        F.col("extra").alias(extra),
    )
    size = F.col(out["size"])
    rank = pareto_rank(F.col("doc_id"), F.col(p), given, seed)
    taken = copies_taken(
        F.col(p), F.col(out["copies"]), F.col(cut), F.col(turns), F.col(extra), rank, F.col("doc_id"), size, size * F.col(n)
    )
    joined = (
        _with_repeats(docs.withColumn(out["size"], word_count(F.col("text"))), out["size"], light, given, n)
        .join(per_source, F.col("source").eqNullSafe(F.col(src)))
        .withColumn(out["copies"], taken)
        .withColumn(out["taken"], F.col(out["copies"]) * size)
        .drop(src, p, cut, turns, extra, n)
    )
    return joined, out


def _with_repeats(docs: DataFrame, size: str, light: DataFrame, odds: Column, n: str) -> DataFrame:
    """How many rows share a row's draw; joined only if some do."""
    counted = light.groupBy("source", "doc_id", "size", "odds").agg(F.count(F.lit(1)).alias("n"))
    repeated = through_table(counted.where("n > 1"), "mix_repeats")
    if repeated.isEmpty():
        return docs.withColumn(n, F.lit(1))
    s, d, z, o, times = fresh(docs, "_s", "_d", "_z", "_o", "_times")
    known = repeated.toDF(s, d, z, o, times)
    same = F.col("source").eqNullSafe(F.col(s)) & F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(size) == F.col(z)) & odds.eqNullSafe(F.col(o))
    return docs.join(known, same, "left").withColumn(n, F.coalesce(times, F.lit(1))).drop(s, d, z, o, times)


def mixed_documents(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    mixed, names = mix_sources(docs, **parameters)
    copy = fresh(mixed, "_copy")[0]
    times = F.col(names["copies"]).cast("int")
    repeated = mixed.where(times > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(1), times)))
    return repeated.select(*docs.columns)
