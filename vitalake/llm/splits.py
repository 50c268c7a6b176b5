"""Splits that keep related records together."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.operators.ranks import blocked_rank
from vitalake.session import cut

SPLITS = ("train", "validation", "test")
PROPORTIONS = (0.8, 0.1, 0.1)
ROUNDS = 60
#: Labels counted one by one; rarer ones beyond are counted together.
MOST_LABELS = 64
#: Profiles of components that the driver plans with.
MOST_PROFILES = 20_000
#: Components of one profile are ranked in blocks of about so many.
BLOCK_COMPONENTS = 100_000
#: The largest components, which are joined by themselves.
LARGEST = 1000
#: Label counts up to this are kept as they are in a component's profile, larger ones to a sixteenth of an octave.
EXACT = 32


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for each node of ``edges`` (a, b).

    Large and small stars in turn: each node's neighbours are linked to the smallest
    of them, until nothing changes; the number of rounds grows as the logarithm of
    the longest path. Each round is written to the shared folder. No node, edge or
    component goes to the driver. Edges from a node to itself make it a component; rows
    with a null are left out.
    """
    pairs = edges.select("a", "b").na.drop()
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = cut(
        pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    for _ in range(ROUNDS):
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Now every link goes from the larger to the smaller node.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        links = cut(small)
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("components have not settled")
    return nodes.join(links.toDF("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def related(records: DataFrame, keys: DataFrame) -> DataFrame:
    """``id`` and ``root``: records related through shared keys, directly or through others.

    ``records``: id. ``keys``: id, key. ``root`` is the smallest id of the group. Null ids and keys
    relate nothing; each id of ``records`` comes out once.
    """
    # A key of very many ids is a star of stars: ids are linked to the least of their part, those to the least of all.
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = keys.select("id", "key", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")).na.drop().distinct()
    first = own.groupBy("key", "part").agg(F.min("id").alias("b"))
    least = first.groupBy("key").agg(F.min("b").alias("c"))
    edges = (
        own.join(first, ["key", "part"]).select(F.col("id").alias("a"), "b")
        .union(first.join(least, "key").select(F.col("b").alias("a"), F.col("c").alias("b")))
        .where("a <> b")
        .distinct()
    )
    ids = records.select("id").where(F.col("id").isNotNull()).distinct()
    return ids.join(components(cut(edges)).withColumnRenamed("node", "id"), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")
    )


def pair_groups(pairs: DataFrame, admissions: DataFrame) -> DataFrame:
    """``pair_id`` and ``group_pair_id``: pairs of one patient, as far as the records tell.

    A pair has the subject_id of its own row and those of all admissions with its
    hadm_id_current or hadm_id_next; pairs that share one are related, directly or through
    further pairs; ``group_pair_id`` is the smallest pair_id of the group.
    """
    visits = (
        pairs.select(F.col("pair_id").alias("id"), F.explode(F.array("hadm_id_current", "hadm_id_next")).alias("hadm_id"))
        .na.drop()
        .distinct()
    )
    known = admissions.select("hadm_id", F.col("subject_id").alias("key")).na.drop().distinct()
    keys = visits.join(known, "hadm_id").select("id", "key").union(pairs.select(F.col("pair_id"), F.col("subject_id")))
    return related(pairs.select(F.col("pair_id").alias("id")), keys).select(
        F.col("id").alias("pair_id"), F.col("root").alias("group_pair_id")
    )


def allot(
    profiles: Sequence[tuple[tuple[float, ...], int]], proportions: Sequence[float] = PROPORTIONS
) -> list[list[int]]:
    """How many components of each profile go to each split.

    ``profiles``: (records of each label in a component, number of such components).
    Iterative stratification: the label with the fewest records outstanding is next; its
    components, those with most of it first, go to the split that lacks it most.
    """
    labels = len(profiles[0][0]) if profiles else 0
    total = [sum(v[j] * n for v, n in profiles) for j in range(labels)]
    lack = [[p * total[j] for j in range(labels)] for p in proportions]
    lack_all = [p * sum(total) for p in proportions]
    left = [n for _, n in profiles]
    out = [[0] * len(proportions) for _ in profiles]

    def give(i: int, s: int, n: int) -> None:
        vector = profiles[i][0]
        out[i][s] += n
        left[i] -= n
        for j in range(labels):
            lack[s][j] -= vector[j] * n
        lack_all[s] -= sum(vector) * n

    outstanding = list(total)
    while any(left):
        rare = min((j for j in range(labels) if any(n and profiles[i][0][j] for i, n in enumerate(left))), key=lambda j: outstanding[j], default=None)
        if rare is None:
            for i, n in enumerate(left):
                give(i, 0, n)
            break
        having = sorted((i for i, n in enumerate(left) if n and profiles[i][0][rare]), key=lambda i: -profiles[i][0][rare])
        for i in having:
            needs = [max(x[rare], 0.0) for x in lack]
            if left[i] > 1000 and sum(needs) > 0:
                # Most of a great number of equal components is shared out at once.
                bulk = left[i] - 1000
                for s in range(len(proportions)):
                    give(i, s, min(left[i], math.floor(bulk * needs[s] / sum(needs))))
            while left[i]:
                give(i, max(range(len(proportions)), key=lambda s: (lack[s][rare], lack_all[s], -s)), 1)
        outstanding = [sum(profiles[i][0][j] * n for i, n in enumerate(left)) for j in range(labels)]
    return out


def _coarse(c: Column, parts: int) -> Column:
    """Counts up to ``EXACT`` as they are, larger ones to ``parts`` steps an octave; with no parts, all to octaves."""
    octave = F.floor(F.log2(c.cast("double")))
    if not parts:
        return F.when(c > 0, octave + 1).otherwise(0)
    step = F.pow(F.lit(2.0), octave) / parts
    return F.when(c <= EXACT, c.cast("double")).otherwise(F.floor(c / step) * step)


def _profiled(vectors: DataFrame, k: int, rare: list[int]) -> DataFrame:
    """``vectors`` with ``profile``: counts of all labels, as finely as ``MOST_PROFILES`` allows.

    Where counts to a sixteenth of an octave and to octaves give too many profiles, a component's profile is its rarest label,
    and the octaves of that label's count and of its size: 64 x 64 of them for each label at most.
    """
    counts = [F.col(f"v{j}") for j in range(k)]
    for parts in (16, 0):
        made = vectors.withColumn("profile", F.concat_ws(",", *[_coarse(c, parts).cast("string") for c in counts]))
        if made.select("profile").distinct().limit(MOST_PROFILES + 1).count() <= MOST_PROFILES:
            return made
    first = F.coalesce(*[F.when(F.col(f"v{j}") > 0, F.struct(F.lit(j).alias("j"), _coarse(F.col(f"v{j}"), 0).alias("n"))) for j in rare])
    size = _coarse(sum(counts[1:], counts[0]), 0)
    return vectors.withColumn("profile", F.concat_ws(",", F.lit("r"), first["j"].cast("string"), first["n"].cast("string"), size.cast("string")))


def grouped_split(
    groups: DataFrame, labels: DataFrame, names: Sequence[str] = SPLITS, proportions: Sequence[float] = PROPORTIONS, seed: int = 0
) -> DataFrame:
    """``id``, ``root`` and ``split``: all records of a group in one split, splits alike in labels.

    ``groups``: id, root. ``labels``: id, label (null is a label of its own; of more than ``MOST_LABELS`` labels the rarest
    are counted together). Components are
    added up to vectors of label counts; only the number of components of each
    profile goes to the driver, ``MOST_PROFILES`` or 4,096 a label at most, which allots them; ranks by hash within a profile pick
    the components, so a run repeats itself. Of several rows with one id, each counts. An
    empty table gives an empty one. Rows of the ``LARGEST`` components are joined by broadcast, so none is in one task.
    """
    counted = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("label").asc_nulls_last())
    common = counted.limit(MOST_LABELS + 1).collect()
    kinds = [r["label"] for r in common]
    others = len(kinds) > MOST_LABELS
    kinds = kinds[: MOST_LABELS - 1] if others else kinds
    with_labels = groups.join(labels.withColumnRenamed("id", "l_id"), F.col("id") == F.col("l_id"), "left")
    same = [F.col("label").eqNullSafe(F.lit(x)) for x in kinds]
    if others:
        same.append(~F.array_contains(F.array(*same), True))
    k = len(same)
    if not k:  # no records at all
        return groups.select("id", "root", F.lit(names[0]).alias("split")).where(F.lit(False))
    vectors = with_labels.groupBy("root").agg(*[F.sum(c.cast("bigint")).alias(f"v{j}") for j, c in enumerate(same)])
    vectors = cut(_profiled(cut(vectors), k, list(range(len(kinds) - 1, -1, -1)) + ([k - 1] if others else [])))
    seen = (
        vectors.groupBy("profile")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{j}").alias(f"v{j}") for j in range(k)])
        .orderBy("profile")
        .collect()
    )
    given = allot([(tuple(r[f"v{j}"] for j in range(k)), r["n"]) for r in seen], proportions)
    spark = groups.sparkSession
    bounds = []
    for r, row in zip(seen, given, strict=True):
        at = 0
        for name, n in zip(names, row, strict=True):
            if n:
                bounds.append((r["profile"], at + 1, at + n, name))
            at += n
    table = spark.createDataFrame(bounds, "profile string, low bigint, high bigint, split string")
    order = F.xxhash64("root", F.lit(seed))
    blocks = max(1, -(-max((r["n"] for r in seen), default=0) // BLOCK_COMPONENTS))
    block = F.floor(F.shiftrightunsigned(order, 32) * F.lit(blocks) / F.lit(1 << 32))
    size = sum((F.col(f"v{j}") for j in range(1, k)), F.col("v0"))
    ranked = blocked_rank(vectors.select("root", "profile", size.alias("size")), ["profile"], [block, order, F.col("root")], block, "r").alias("x")
    placed = cut(
        ranked.join(
            F.broadcast(table.alias("t")),  # three rows a profile
            (F.col("x.profile") == F.col("t.profile")) & F.col("x.r").between(F.col("t.low"), F.col("t.high")),
        ).select("x.root", "x.size", "t.split")
    )
    hot = F.broadcast(placed.orderBy(F.desc("size"), "root").limit(LARGEST).select("root", "split"))
    pairs = groups.select("id", "root")
    rest = pairs.join(hot, "root", "left_anti").join(placed.select("root", "split"), "root")
    return pairs.join(hot, "root").unionByName(rest).select("id", "root", "split")
