"""A Merkle manifest of a table: a tree of digests for each group, and one tree over the groups' roots.

Leaves of a group are numbered by a range sort; 16 consecutive nodes at a time are hashed into a node of the next
level until one is left.  Every level is written as rows of a table: a row is a run, holds the digests of its up to 16
members in one binary, and is linked to the run that it is a member of.

A recursive query climbs from the leaves to the root along these links.  It carries the leaves of one run
of the lowest level in a row, as they share all that is above them: the digest folded from the untouched leaves,
one digest folded from each tampered leaf, and the siblings met so far, which each step lengthens.

Digests are folded as lowercase hexadecimal text and stored as 32 bytes; the text of joined bytes is the joined text.
Many rows climb through the high runs, so a run is repeated under numbered salts, at most some ``PER_KEY`` climbing rows for
each, and a row picks its salt by hash.  The repeated rows are fewer than one in ``PER_KEY`` climbing rows and level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playtrail.operators.ordering import positions
from playtrail.scratch import through_table

FAN = 16
#: Climbing rows that meet under one join key.
PER_KEY = 4096
#: The tree over the groups; groups have names that begin with "n" (the null group) or "s".
TOP = "t"

_ROWS = "spark.sql.cteRecursionRowLimit"


def field(column: Column) -> Column:
    """A value as hashed: its length in bytes, a colon and its text; a hyphen for null."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def text_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def row_digest(columns: list[Column]) -> Column:
    """The digest of a row: of its fields, joined."""
    return digest_of(F.concat(*[field(c) for c in columns]))


@dataclass
class Tree:
    """``leaf_runs``: the lowest runs with their leaves; ``nodes``: the runs above; ``root``: hexadecimal, None without leaves."""

    leaf_runs: DataFrame
    nodes: DataFrame | None
    root: str | None


def _quotient(c: str) -> Column:
    return F.floor(F.col(c) / FAN).cast("bigint")


def _joined(kids: Column, digest: str) -> Column:
    return F.unhex(F.array_join(F.transform(kids, lambda k: F.hex(k[digest])), ""))


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """Runs of consecutive nodes (g, idx, digest, weight)."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "digest")))
    grouped = nodes.groupBy("g", _quotient("idx").alias("run")).agg(kids.alias("kids"), F.sum("weight").alias("weight"))
    with_members = grouped.select("g", F.lit(level).alias("level"), "run", "weight", _joined(F.col("kids"), "digest").alias("members"))
    return with_members.withColumn("digest", digest_of(text_of(F.col("members"))))


def _parents_salts(level: int) -> int:
    """Salts of a group's run above ``level``: below it are at most so many of the lowest runs."""
    return max(1, FAN**level // PER_KEY)


def _linked(runs: DataFrame, level: int, sources: DataFrame) -> DataFrame:
    """Runs of groups with the link to the run above: in the group's tree, or from its last run to the tree over the groups."""
    up = [
        F.col("g").alias("up_g"), F.lit(level + 1).alias("up_level"), _quotient("run").alias("up_run"),
        F.lit(_parents_salts(level)).cast("bigint").alias("up_salts"), F.pmod("run", F.lit(FAN)).cast("int").alias("up_slot"),
        F.lit(False).alias("lone"), F.lit(None).cast("binary").alias("subroot"),
    ]
    last = F.col("height") == level
    over = {
        "up_g": F.lit(TOP), "up_level": F.lit(1), "up_run": _quotient("ord"), "up_salts": F.col("top_salts"),
        "up_slot": F.pmod("ord", F.lit(FAN)).cast("int"), "lone": F.col("n") == 1, "subroot": F.col("root_digest"),
    }
    # Only a group's first run can be its last: one row of a group meets the groups' table.
    first = runs.where("run = 0").select("*", *up).join(sources.withColumnRenamed("g", "_g"), F.col("g") == F.col("_g"))
    first = first.withColumns({c: F.when(last, over[c]).otherwise(F.col(c)) for c in over}).select(*runs.columns, *over)
    return runs.where("run > 0").select("*", *up).select(*runs.columns, *over).unionByName(first)


def build(leaves: DataFrame) -> Tree:
    """The tree of ``leaves`` (g, id, leaf, tampered): in each group by id, nulls first, ties by digest.

    ``g`` is not null.  ``tampered`` is null where a leaf is untouched.
    """
    slim = through_table(leaves.select("g", "id", "leaf", "tampered"), "leaves")
    order = [F.asc_nulls_first("id"), F.asc("leaf"), F.asc_nulls_first("tampered")]
    numbered = positions(slim, order, keys=["g"], name="idx").withColumn("idx", F.col("idx") - 1)
    kids = F.sort_array(F.collect_list(F.struct("idx", "id", "leaf", "tampered")))
    grouped = numbered.groupBy("g", _quotient("idx").alias("run")).agg(kids.alias("kids"))
    lowest = grouped.withColumn("members", _joined(F.col("kids"), "leaf"))
    lowest = through_table(lowest.withColumn("digest", digest_of(text_of(F.col("members")))), "leaf_runs")
    # One row per group from here: number of leaves and of lowest runs, and how many levels of runs it has.
    sizes = lowest.groupBy("g").agg(F.sum(F.size("kids")).alias("n"), (F.max("run") + 1).alias("weight"))
    digits = F.length(F.conv((F.col("weight") - 1).cast("string"), 10, FAN))
    sizes = sizes.withColumn("height", F.when(F.col("weight") == 1, 1).otherwise(1 + digits))
    sources = through_table(positions(sizes, [F.asc("g")], name="ord").withColumn("ord", F.col("ord") - 1), "groups")
    count, highest = sources.agg(F.count(F.lit(1)), F.max("height")).first()
    if not count:
        return Tree(lowest.withColumns(_no_links()), None, None)

    levels = [lowest]
    for level in range(2, highest + 1):
        below = levels[-1].select("g", F.col("run").alias("idx"), "digest", *(["weight"] if level > 2 else [F.lit(1).cast("bigint").alias("weight")]))
        goes_on = below.where("idx = 0").join(sources.where(F.col("height") >= level).select("g"), "g", "left_semi")
        levels.append(through_table(_runs(below.where("idx > 0").unionByName(goes_on), level), f"level_{level}"))
    firsts = [
        runs.where("run = 0").select("g", F.lit(level).alias("height"), "members", "digest") for level, runs in enumerate(levels, 1)
    ]
    last = firsts[0]
    for f in firsts[1:]:
        last = last.unionByName(f)
    found = sources.join(last, ["g", "height"])
    subroot = F.when(F.col("n") == 1, F.col("members")).otherwise(F.col("digest"))
    sources = through_table(found.select("g", "n", "weight", "height", "ord", subroot.alias("root_digest")), "subroots")

    top, width = [], count
    nodes = sources.select(F.lit(TOP).alias("g"), F.col("ord").alias("idx"), F.col("root_digest").alias("digest"), "weight")
    while not top or width > 1:
        width = -(-width // FAN)
        top.append(through_table(_runs(nodes, len(top) + 1), "top"))
        nodes = top[-1].select("g", F.col("run").alias("idx"), "digest", "weight")
    members, digest = top[-1].select("members", "digest").first()
    root = bytes(members if count == 1 else digest).hex()

    salts = F.greatest(F.lit(1), F.ceil(F.col("weight") / PER_KEY)).cast("bigint")
    above = top[0].select(F.col("run").alias("_run"), salts.alias("top_salts"))
    sources = sources.join(above, _quotient("ord") == F.col("_run")).drop("_run", "weight")
    rows = [
        _linked(runs, level, sources).withColumn("salts", F.lit(_parents_salts(level - 1)).cast("bigint"))
        for level, runs in enumerate(levels[1:], 2)
    ]
    for level, runs in enumerate(top, 1):
        link = _no_links() | {"lone": F.lit(count == 1), "salts": salts}
        if level < len(top):
            parent = top[level].select(F.col("run").alias("_run"), salts.alias("_salts"))
            runs = runs.join(parent, _quotient("run") == F.col("_run")).drop("_run")
            link |= {
                "up_g": F.lit(TOP), "up_level": F.lit(level + 1), "up_run": _quotient("run"), "up_salts": F.col("_salts"),
                "up_slot": F.pmod("run", F.lit(FAN)).cast("int"),
            }
        rows.append(runs.withColumns(link).drop("_salts"))
    nodes = rows[0]
    for r in rows[1:]:
        nodes = nodes.unionByName(r)
    nodes = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts", "weight")
    return Tree(_linked(lowest, 1, sources), through_table(nodes, "nodes"), root)


def _no_links() -> dict[str, Column]:
    kinds = {"up_g": "string", "up_level": "int", "up_run": "bigint", "up_salts": "bigint", "up_slot": "int", "subroot": "binary"}
    return {c: F.lit(None).cast(k) for c, k in kinds.items()} | {"lone": F.lit(False)}


CLIMB = """
WITH RECURSIVE climb (g, run, clean, folds, siblings, subroot, up_g, up_level, up_run, up_salt, up_slot) AS (
  SELECT g, run, clean, folds, siblings, subroot, up_g, up_level, up_run, up_salt, up_slot FROM {lowest}
  UNION ALL
  SELECT c.g, c.run,
    IF(n.lone, c.clean, unhex(sha2(lower(hex(concat(
      substring(n.members, 1, 32 * c.up_slot), c.clean, substring(n.members, 32 * c.up_slot + 33)))), 256))),
    transform(c.folds, f -> IF(n.lone, f, unhex(sha2(lower(hex(concat(
      substring(n.members, 1, 32 * c.up_slot), f, substring(n.members, 32 * c.up_slot + 33)))), 256)))),
    concat(c.siblings, substring(n.members, 1, 32 * c.up_slot), substring(n.members, 32 * c.up_slot + 33)),
    coalesce(c.subroot, n.subroot),
    n.up_g, n.up_level, n.up_run, pmod(xxhash64(c.g, c.run), n.up_salts), n.up_slot
  FROM climb c JOIN {nodes} n
    ON n.g = c.up_g AND n.level = c.up_level AND n.run = c.up_run AND n.salt = c.up_salt
)
SELECT g, run, clean, folds, siblings, subroot FROM climb WHERE up_g IS NULL
"""


def _without(members: Column, slot: Column, instead: Column | None = None) -> Column:
    """The digests of a run but for the one at ``slot``, which another may replace."""
    parts = [F.substring(members, F.lit(1), slot * 32), instead, F.substring(members, slot * 32 + 33, F.octet_length(members))]
    return F.concat(*[p for p in parts if p is not None])


def proofs(tree: Tree) -> DataFrame:
    """Every leaf's way up: g, id, leaf, tampered, subroot, clean, folded (binaries) and siblings.

    ``siblings`` joins the other members of each run on the way, from the lowest run to the root, left to right.  ``clean`` is
    the digest that the untouched leaf folds to, ``folded`` that of the tampered leaf, or of the leaf where it is untouched.
    """
    spark = tree.leaf_runs.sparkSession
    lone, members = F.col("lone"), F.col("members")

    def folded(k: Column, i: Column) -> Column:
        return F.when(lone, k["tampered"]).otherwise(digest_of(text_of(_without(members, i, k["tampered"]))))

    lowest = tree.leaf_runs.select(
        "g", "run", F.when(lone, members).otherwise(F.col("digest")).alias("clean"), F.transform("kids", folded).alias("folds"),
        F.lit(b"").alias("siblings"), "subroot", "up_g", "up_level", "up_run",
        F.pmod(F.xxhash64("g", "run"), F.col("up_salts")).alias("up_salt"), "up_slot",
    )
    if tree.nodes is None:
        climbed = lowest.select("g", "run", "clean", "folds", "siblings", "subroot")
    else:
        before = spark.conf.get(_ROWS)
        spark.conf.set(_ROWS, "-1")  # the limit is meant for queries that don't end
        try:
            climbed = through_table(spark.sql(CLIMB, lowest=lowest, nodes=tree.nodes), "climbed")
        finally:
            spark.conf.set(_ROWS, before)
    below = tree.leaf_runs.select(F.col("g").alias("_g"), F.col("run").alias("_run"), "kids", "members")
    met = climbed.join(below, (F.col("g") == F.col("_g")) & (F.col("run") == F.col("_run")))
    out = met.select("*", F.posexplode("kids").alias("_slot", "_kid"))
    return out.select(
        "g", F.col("_kid.id").alias("id"), F.col("_kid.leaf").alias("leaf"), F.col("_kid.tampered").alias("tampered"), "subroot", "clean",
        F.coalesce(F.col("folds")[F.col("_slot")], F.col("clean")).alias("folded"),
        F.concat(_without(members, F.col("_slot")), F.col("siblings")).alias("siblings"),
    )


def group_name(column: Column) -> Column:
    """A group's name: nulls before all others, the others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def manifest(
    docs: DataFrame, columns: list[str], key: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None, where: Column | None = None
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and what its tampered form folds to.

    Rows are hashed over ``columns``; where ``where`` holds, the columns of ``tampered`` have other values in the
    tampered row.  Returns ``key``, leaf, subroot, root, siblings, folded_root (hexadecimal) and verified.  Equal rows are leaves
    of their own, next to each other; a null key comes first in its group; columns that aren't named count for nothing.
    An empty table gives an empty one.
    """
    plain = [docs[c] for c in columns]
    other = row_digest([(tampered or {}).get(c, docs[c]) for c in columns])
    changed = F.when(where, other) if where is not None else F.lit(None).cast("binary")
    leaves = docs.select(
        group_name(docs[group]).alias("g"), docs[key].alias("id"), row_digest(plain).alias("leaf"), changed.alias("tampered")
    )
    tree = build(leaves)
    root = F.lit(tree.root).cast("string")
    found = proofs(tree).select(
        F.col("id").alias(key), text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), root.alias("root"),
        text_of(F.col("siblings")).alias("siblings"), text_of(F.col("folded")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
