"""Sharding by balanced label propagation.

Documents with equal texts are linked. Every linked document begins in the
shard that its hash names; in each round it looks at the shards of the
documents it is linked with and asks to move to the one that most of them are
in (a group larger than a shard, to as many of the fullest as it needs).
Requests into a shard are granted as far as its quota goes, group by group in
the order of a hash. Then every group is given one shard: large groups are
packed by falling size, small ones stay in their fullest shard while its quota
lasts, and those left over go to shards with room. A group is cut only where no
shard has room for it. Documents without links fill what is free, so that
counts end at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm._store import materialise, numbered, small

ROUNDS = 6


def _loads(df: DataFrame, col: str, shards: int) -> list[int]:
    """Rows by shard: one number for each shard."""
    found = {r[col]: r["count"] for r in df.groupBy(col).count().collect()}
    return [found.get(s, 0) for s in range(shards)]


def _round(linked: DataFrame, quotas: list[int], rnd: int) -> tuple[DataFrame, int]:
    """One round of moves, and how many there were."""
    shards = len(quotas)
    cells = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
    ranked = cells.groupBy("group").agg(
        F.sum("n").alias("members"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), F.xxhash64("group", "shard").alias("tie"), "shard"))).alias("by_n")
    )
    wanted = ranked.select(
        "group", F.slice(F.transform("by_n", lambda c: c["shard"]), 1, F.ceil(F.col("members") / min(quotas)).cast("int")).alias("aims")
    )
    asked = linked.join(small(materialise(wanted)), "group")
    at = F.pmod(F.xxhash64("row", F.lit(rnd)), F.size("aims")).cast("int")
    stays = F.array_contains("aims", F.col("shard"))
    asked = asked.withColumn("aim", F.when(stays, F.col("shard")).otherwise(F.get("aims", at)))
    flows = asked.filter("aim <> shard").groupBy("shard", "aim").count().collect()
    come, go = [0] * shards, [0] * shards
    for r in flows:
        come[r["aim"]] += r["count"]
        go[r["shard"]] += r["count"]
    loads = _loads(linked, "shard", shards)
    grant = [min(1.0, max(0, quotas[s] - loads[s] + go[s]) / come[s]) if come[s] else 0.0 for s in range(shards)]
    share = F.get(F.array(*map(F.lit, grant)), F.col("aim"))
    one = F.when(F.size("aims") == 1, F.xxhash64("group", F.lit(rnd))).otherwise(F.xxhash64("row", F.lit(-rnd)))
    granted = F.pmod(one, F.lit(1 << 20)) < share * (1 << 20)
    shard = F.when((F.col("aim") != F.col("shard")) & granted, F.col("aim")).otherwise(F.col("shard"))
    moved = asked.select(*(c for c in linked.columns if c != "shard"), shard.cast("int").alias("shard"))
    return materialise(moved), sum(come)


def _pack(sizes: list[int], free: list[int]) -> list[list[tuple[int, int]]]:
    """(shard, rows) pieces of each size, largest first; `free` is used up.

    A group goes whole into the fullest shard with room, and is cut, into the
    shards with most room, only if there is none.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        left = sizes[i]
        while left:
            fits = [s for s, n in enumerate(free) if n >= left]
            s = min(fits, key=lambda s: (free[s], s)) if fits else max(range(len(free)), key=lambda s: (free[s], -s))
            n = min(left, free[s])
            out[i].append((s, n))
            free[s] -= n
            left -= n
    return out


def _whole(linked: DataFrame, quotas: list[int]) -> DataFrame:
    """linked with a shard for each row: no quota is exceeded, and as few groups as may be are cut.

    The driver packs groups of over 1/64 of a quota (64 a shard at most) and
    those that lie on a border between two shards' room (one a shard at most).
    """
    shards, spark = len(quotas), linked.sparkSession
    cells = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
    homes = cells.groupBy("group").agg(
        F.sum("n").alias("members"), F.max(F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard"))["shard"].alias("home")
    )
    homes = materialise(homes)
    large = F.col("members") > max(1, min(quotas) // 64)
    named = [(r["group"], r["members"]) for r in homes.filter(large).collect()]
    named.sort(key=lambda g: (-g[1], g[0]))
    free = list(quotas)
    pieces = _pack([n for _, n in named], free)
    longs = lambda ns: F.array(*(F.lit(n).cast("long") for n in ns))
    # small groups stay at home in stored order, as far as there is room
    stored = materialise(numbered(materialise(homes.filter(~large)), "before", ["home"], "members"))
    stays = F.col("before") + F.col("members") <= F.get(longs(free), F.col("home"))
    at_home = stored.filter(stays).select("group", F.col("home").cast("int").alias("to"))
    for r in stored.filter(stays).groupBy("home").agg(F.sum("members").alias("n")).collect():
        free[r["home"]] -= r["n"]
    # the others go along the room that all shards have left, one after another
    upto = [0]
    for n in free:
        upto.append(upto[-1] + n)
    loose = numbered(materialise(stored.filter(~stays).select("group", "members")), "at", weight="members")
    to = F.size(F.filter(longs(upto[1:]), lambda b: b <= F.col("at"))).cast("int")
    loose = materialise(loose.withColumn("to", to))
    fits = F.col("at") + F.col("members") <= F.get(longs(upto[1:]), F.col("to"))
    moved = loose.filter(fits).select("group", "to")
    for r in loose.filter(fits).groupBy("to").agg(F.sum("members").alias("n")).collect():
        free[r["to"]] -= r["n"]
    last = [(r["group"], r["members"]) for r in loose.filter(~fits).collect()]
    last.sort(key=lambda g: (-g[1], g[0]))
    pieces += _pack([n for _, n in last], free)
    named += last
    plans = [(g, [s for s, _ in p], [sum(n for _, n in p[: i + 1]) for i in range(len(p))]) for (g, _), p in zip(named, pieces, strict=True)]
    plan = small(materialise(spark.createDataFrame(plans, "group string, tos array<int>, upto array<long>")))
    cols = [c for c in linked.columns if c != "shard"]
    one = linked.join(plan.filter(F.size("tos") == 1), "group").select(*cols, F.get("tos", F.lit(0)).alias("shard"))
    cut = materialise(linked.join(plan.filter(F.size("tos") > 1), "group").select(*cols, "tos", "upto"))
    nth = materialise(numbered(cut, "nth", ["group"]))
    piece = F.get("tos", F.size(F.filter("upto", lambda b: b <= F.col("nth"))))
    rest = linked.join(plan.select("group"), "group", "left_anti").drop("shard")
    rest = rest.join(small(materialise(at_home.union(moved))), "group").select(*cols, F.col("to").alias("shard"))
    return one.union(nth.select(*cols, piece.alias("shard"))).union(rest)


def assign_shards(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    groups: bool = False,
) -> DataFrame:
    """id, size, text_crc32, shard, slot of every row; counts are at most one apart.

    size is the text's UTF-8 bytes plus 16. slot numbers a shard's rows from 0
    without gaps. Rows with equal texts, '' among them, are linked and put into
    one shard as far as its quota allows; null texts (16 bytes, CRC 0) are linked
    with nothing. Null ids and repeated rows are rows like any others; of a very
    long text only size and hashes are carried on. Other
    columns are ignored. An empty table gives an empty result. With `groups` the
    texts' hashes are added, for cut_links().

    Groups and rows are only joined, counted and stored; some numbers for each
    shard and the sizes of at most 65 groups a shard reach the driver. A group that holds a third of all rows is counted by
    partial sums, and fills as few shards as it can.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.col(text_col)
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit("second"), text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNotNull(), F.concat_ws("-", F.hex(h1), F.hex(h2))).alias("group"),
        F.xxhash64(F.col(id_col), h1, h2).alias("row"),
    )
    rows = materialise(rows)
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    several = rows.filter("group is not null").groupBy("group").count().filter("count > 1").select("group", F.lit(True).alias("linked"))
    marked = materialise(rows.join(small(materialise(several)), "group", "left").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))
    linked = materialise(marked.filter("linked").drop("linked"))
    if min(quotas) > 0:
        for rnd in range(1, rounds + 1):
            linked, moves = _round(linked, quotas, rnd)
            if not moves:
                break
    linked = materialise(_whole(linked, quotas))
    placed = materialise(numbered(linked, "slot", ["shard"]))
    quota = F.get(F.array(*map(F.lit, quotas)), F.col("shard")).cast("long")
    held = [min(n, q) for n, q in zip(_loads(linked, "shard", shards), quotas, strict=True)]
    cols = ["id", "size", "text_crc32", *(["group"] if groups else [])]
    rest = placed.filter(F.col("slot") >= quota).select(cols).union(marked.filter("linked is null").select(cols))
    free, upto = [q - h for q, h in zip(quotas, held, strict=True)], [0]
    for n in free:
        upto.append(upto[-1] + n)
    bounds = F.array(*(F.lit(n).cast("long") for n in upto[1:]))
    starts = F.array(*(F.lit(h - u).cast("long") for h, u in zip(held, upto[:-1], strict=True)))
    filled = numbered(materialise(rest), "nth").withColumn(
        "shard", F.size(F.filter(bounds, lambda b: b <= F.col("nth"))).cast("int")
    )
    filled = filled.select(*cols, "shard", (F.get(starts, F.col("shard")) + F.col("nth")).alias("slot"))
    out = placed.filter(F.col("slot") < quota).select(*cols, "shard", "slot").union(filled)
    return out.withColumnRenamed("id", id_col)


def cut_links(placed: DataFrame) -> DataFrame:
    """groups, links, cut: of groups of equal texts, the least links that join them and those between shards.

    `placed` is assign_shards(..., groups=True). A group of m rows has m - 1 links,
    and in s shards s - 1 of them are cut.
    """
    cells = placed.filter("group is not null").groupBy("group", "shard").count()
    found = cells.groupBy("group").agg(F.sum("count").alias("members"), F.count("*").alias("shards")).filter("members > 1")
    return found.agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("links"),
        F.coalesce(F.sum(F.col("shards") - 1), F.lit(0)).alias("cut"),
    )
