"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours, thresholded to links.

Vectors meet only within a label and a dimension (a `space`). Equal vectors are one node with a multiplicity. The graph starts
from blocks of bounded size: vectors that lie on one side of as many random planes as their space needs, large blocks split at
random. A round then brings together, at every node, its neighbours and the nodes it is a neighbour of; pairs of them that beat
a current list enter it. Rounds end when few entries change. A node whose whole list reaches the threshold is saturated: its
list is enlarged to all of its component and of every other component with saturated nodes that a bound on centres and radii
does not rule out, compared in pairs of blocks of which only counts leave a task; components that so meet become one. The recall
of links is audited against brute force for nodes by hash until SEEN of them have links (all nodes where so few have), and while
it is low the graph gets further blocks and rounds; if these no longer raise it, `exact_links` takes the place of the lists: all
vectors lie in balls around leaders, and pairs of blocks whose balls may hold a link are compared in full.

Links are those of cosine >= threshold in double precision. A row is left alone (no links, a component of its own) if its
vec_id, label or vector is null, or the vector is empty, zero, or holds a null or non-finite component; without vec_id the
component is null and the row is kept. Rows that repeat a vec_id count as vectors of their own. Extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import components, table, tell_workers, written

K, TABLES, PLANES, BLOCK = 12, 4, 24, 256
#: Nodes of a task that looks for their leaders.
ROWS = 4096
#: Parts of components whose centres are compared at a time; what rounding may add to an angle.
BALLS, SLACK = 1024, 1e-6
#: Nodes with links that an audit goes on to see; nodes audited at a time, at most.
SEEN, MOST_AUDITED = 100, 2000
#: Rounds end at this share of changed entries, at the latest after ROUNDS; nodes audited at first, recall asked for, attempts
#: to reach it (more while they raise it).
CHANGED, ROUNDS, AUDITED, RECALL, ATTEMPTS = 0.002, 8, 500, 0.98, 3


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, nodes): the node of every row (null if left alone), and id, space, vector, multiplicity of every node."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    size = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~bad & (size > 0), F.lit(False))
    key = F.struct(F.col("label"), F.size(v).alias("d"), F.xxhash64(v).alias("h"), F.xxhash64(F.lit(1), v).alias("h2"))
    keyed = rows.select("vec_id", F.when(good, key).alias("key"), F.when(good, v).alias("v"))
    known = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v"))
    space = F.concat_ws("/", F.col("key.label").cast("string"), F.col("key.d").cast("string"))
    known = written(known.select("key", "id", space.alias("space"), F.col("v").cast("array<float>").alias("v"), "m"))
    members = keyed.select("vec_id", "key").join(known.select("key", "id"), "key", "left").select("vec_id", "id")
    return members, known.drop("key")


@lru_cache(8)
def _planes(attempt: int, d: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([attempt, d])).standard_normal((TABLES, PLANES, d))


def _blocks(known: DataFrame, attempt: int) -> DataFrame:
    """(u, w, sim) of every node's nearest within its blocks of TABLES tables."""

    def codes(batches):
        for batch in batches:
            out = []
            for v in batch["v"]:
                out.append(((_planes(attempt, len(v)) @ np.asarray(v, np.float64)) > 0) @ (1 << np.arange(PLANES)))
            yield batch.assign(codes=out)

    coded = known.select("id", "space", "v").mapInPandas(codes, "id long, space string, v array<float>, codes array<long>")
    sizes = known.groupBy("space").agg(F.greatest(F.ceil(F.log2(F.count("*") / BLOCK)), F.lit(0)).alias("bits"))
    coded = coded.join(sizes, "space").select("id", "space", "v", "bits", F.posexplode("codes").alias("t", "code"))
    coded = written(coded.withColumn("code", F.col("code").bitwiseAND(F.pow(F.lit(2), F.least("bits", F.lit(PLANES))).cast("long") - 1)).drop("bits"))
    counts = coded.groupBy("space", "t", "code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    split = coded.join(counts, ["space", "t", "code"]).withColumn("part", F.pmod(F.xxhash64("id", "t", F.lit(attempt)), "parts"))

    def nearest(block: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unit(block["v"]), block["id"].to_numpy()
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        k = min(K, len(ids) - 1)
        if not k:
            return pd.DataFrame({"u": ids[:0], "w": ids[:0], "sim": np.empty(0)})
        top = np.argpartition(-sims, k - 1, 1)[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "w": ids[top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel()})

    return split.groupBy("space", "t", "code", "part").applyInPandas(nearest, "u long, w long, sim double")


def _best(entries: DataFrame) -> DataFrame:
    """The K best entries of every node; an entry is new if no older one has its pair."""
    merged = entries.groupBy("u", "w").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "w"))
    return merged.withColumn("r", rank).where(F.col("r") <= K).drop("r")


def _round(graph: DataFrame, known: DataFrame) -> DataFrame:
    """Entries that neighbours of a common node give each other."""
    back = graph.select(F.col("w").alias("v"), F.col("u").alias("x"), "new", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("sim"), "u")).alias("r"))
    lists = graph.select(F.col("u").alias("v"), F.col("w").alias("x"), "new").unionByName(back.where(F.col("r") <= K).drop("r"))
    lists = lists.groupBy("v", "x").agg(F.max("new").alias("new"))
    lists = lists.withColumn("any", F.max("new").over(Window.partitionBy("v"))).where("any").drop("any")
    full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("kth"))
    limit = full.select(F.col("u").alias("x"), F.when(F.col("n") >= K, F.col("kth")).otherwise(-2.0).alias("kth"))
    vectors = known.select(F.col("id").alias("x"), F.col("v").alias("vector"), F.size("v").alias("d")).join(limit, "x", "left").withColumn("kth", F.coalesce("kth", F.lit(-2.0)))
    buckets = F.lit(max(1, graph.count() // 20_000))
    gathered = lists.join(vectors, "x").withColumn("bucket", F.pmod(F.xxhash64("v"), buckets))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v", kind="stable")
        x, ids = _unit(rows["vector"]), rows["x"].to_numpy()
        new, kth, v = rows["new"].to_numpy(), rows["kth"].to_numpy(), rows["v"].to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v))
        us, ws, sims = [], [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            s = x[a:b] @ x[a:b].T
            good = (s > kth[a:b, None]) & (new[a:b, None] | new[None, a:b])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            us.append(ids[a + i])
            ws.append(ids[a + j])
            sims.append(s[i, j])
        out = pd.DataFrame({"u": np.concatenate(us), "w": np.concatenate(ws), "sim": np.concatenate(sims)})
        return out.drop_duplicates(["u", "w"])

    return gathered.groupBy("d", "bucket").applyInPandas(meet, "u long, w long, sim double")


def graph_of(known: DataFrame, total: int, attempt: int, start: DataFrame | None = None) -> DataFrame:
    """The neighbour graph (u, w, sim)."""
    entries = _blocks(known, attempt).withColumn("new", F.lit(True))
    if start is not None:
        entries = entries.unionByName(start.withColumn("new", F.lit(False)))
    graph = written(_best(entries))
    for _ in range(ROUNDS):
        more = _round(graph, known).withColumn("new", F.lit(True))
        graph = written(_best(graph.withColumn("new", F.lit(False)).unionByName(more)))
        if graph.where("new").count() <= CHANGED * K * total:
            break
    return graph.drop("new")


def _near_balls(inside: DataFrame, threshold: float) -> DataFrame:
    """(c, i, d, j): the parts of components that hold two vectors at the threshold, if any two of their vectors do: parts of one
    component, and those of others whose centres are no further apart than both radii and the threshold's angle."""

    def ball(rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(rows["v"])
        centre = x.sum(0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        first = rows.iloc[0]
        return pd.DataFrame({"space": [first["space"]], "c": [first["component"]], "i": [first["part"]], "centre": [centre.tolist()], "radius": [radius], "asks": [bool(rows["asks"].any())]})

    balls = inside.groupBy("component", "part").applyInPandas(ball, "space string, c long, i int, centre array<double>, radius double, asks boolean")
    balls = written(balls)
    sizes = balls.groupBy("space").agg(F.ceil(F.count("*") / BALLS).cast("int").alias("groups"))
    dealt = balls.join(sizes, "space").withColumn("g", F.pmod(F.xxhash64("c", "i"), "groups").cast("int"))
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    fields = ["space", "c", "i", "centre", "radius"]
    mine = sides.where("asks").select(*fields, F.col("g").alias("p"), F.col("other").alias("q"), F.lit(True).alias("ask"))
    theirs = sides.select(*fields, F.col("other").alias("p"), F.col("g").alias("q"), F.lit(False).alias("ask"))
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + SLACK

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        ask = rows["ask"].to_numpy()
        a, b = rows[ask], rows[~ask]
        if not len(a) or not len(b):
            return pd.DataFrame({"c": [], "i": [], "d": [], "j": []}).astype("int64")
        apart = np.arccos(np.clip(np.array(a["centre"].tolist()) @ np.array(b["centre"].tolist()).T, -1, 1))
        near = apart <= a["radius"].to_numpy()[:, None] + b["radius"].to_numpy()[None] + reach
        x, y = np.nonzero(near | (a["c"].to_numpy()[:, None] == b["c"].to_numpy()[None]))
        return pd.DataFrame({"c": a["c"].to_numpy()[x], "i": a["i"].to_numpy()[x], "d": b["c"].to_numpy()[y], "j": b["i"].to_numpy()[y]})

    return mine.unionByName(theirs).groupBy("space", "p", "q").applyInPandas(meet, "c long, i int, d long, j int")


def links_of(graph: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(id, others, component) of every node that has a link: the vectors it is linked with, copies of other nodes included."""
    close = graph.where(F.col("sim") >= threshold)
    both = written(close.select("u", "w").unionByName(close.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct())
    label = components(both, "u", "w")
    weights = known.select(F.col("id").alias("w"), "m")
    listed = both.join(weights, "w").groupBy(F.col("u").alias("id")).agg(F.sum("m").alias("others"))
    saturated = close.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= K).select("id", F.lit(True).alias("asks"))
    placed = written(label.join(saturated, "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False))).join(known, "id"))
    asked = placed.groupBy("component").agg(F.max("asks").alias("some"), F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).where("some").drop("some")
    inside = written(placed.join(asked, "component").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")))
    pairs = written(_near_balls(inside, threshold))
    sides = inside.select("component", "part", "id", "v", "m", "asks")
    mine = sides.where("asks").withColumnsRenamed({"component": "c", "part": "i"}).join(pairs, ["c", "i"]).withColumn("mine", F.lit(True))
    theirs = sides.withColumnsRenamed({"component": "d", "part": "j"}).join(pairs, ["d", "j"]).withColumn("mine", F.lit(False))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        ask, c, d = rows["mine"].to_numpy(), rows["c"].iat[0], rows["d"].iat[0]
        x, ids, m, own = _unit(rows["v"]), rows["id"].to_numpy(), rows["m"].to_numpy(), rows["asks"].to_numpy()
        near = (x[ask] @ x[~ask].T >= threshold) & (ids[ask][:, None] != ids[~ask][None])
        out = pd.DataFrame({"id": ids[ask], "all": near @ m[~ask], "more": 0})
        if c != d:  # a node that does not ask lists no node of another component
            out = pd.concat([out, pd.DataFrame({"id": ids[~ask], "all": 0, "more": m[ask] @ near})[~own[~ask] & near.any(0)]])
        return out.assign(c=c, d=d, met=bool(near.any()))

    met = written(mine.unionByName(theirs).groupBy("c", "i", "d", "j").applyInPandas(count, "id long, all long, more long, c long, d long, met boolean"))
    counted = met.groupBy("id").agg(F.sum("all").alias("all"), F.sum("more").alias("more")).join(saturated, "id", "left")
    counted = counted.select("id", F.when(F.col("asks"), F.col("all")).alias("all"), "more")
    joined = components(met.where("met AND c <> d").select("c", "d").distinct(), "c", "d").select(F.col("id").alias("component"), F.col("component").alias("whole"))
    label = label.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    others = F.coalesce("all", F.col("others") + F.coalesce("more", F.lit(0))).alias("others")
    return label.join(listed, "id").join(counted, "id", "left").select("id", others, "component")


def exact_links(known: DataFrame, threshold: float) -> DataFrame:
    """(id, others, component) of every node that has a link, without the graph: the way for nodes whose lists stay incomplete.
    Nodes join the nearest of a number of leaders, drawn by hash, that grows with the root of their space; blocks of one leader, and those of
    leaders whose balls are near enough to hold a link, are compared. A pair of blocks gives counts, and a link of every node
    in it to the smallest node that it reaches there: enough for components, never more rows than nodes."""
    first, n = F.min(F.struct(F.xxhash64("id"), "id"))["id"].alias("first"), F.count("*").alias("n")
    sizes = known.groupBy("space").agg(n, first).withColumn("salts", F.ceil(F.col("n") / ROWS).cast("int"))
    dealt = known.join(sizes, "space")
    leads = (F.pmod(F.xxhash64("id", F.lit(3)), "n") < F.ceil(F.sqrt(F.col("n") / BLOCK))) | (F.col("id") == F.col("first"))
    leaders = dealt.where(leads).select(F.col("space").alias("s"), F.col("id").alias("leader"), F.col("v").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("t"))
    salted = dealt.withColumn("salt", F.pmod(F.xxhash64("id"), "salts").cast("int")).select("space", "id", "v", "salt")

    def join(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"id": [], "component": []}).astype("int64")
        centres = centres.sort_values("leader")
        best = (_unit(rows["v"]) @ _unit(centres["centre"]).T).argmax(1)
        return pd.DataFrame({"id": rows["id"], "component": centres["leader"].to_numpy()[best]})

    nearest = salted.groupBy("space", "salt").cogroup(leaders.groupBy("s", "t")).applyInPandas(join, "id long, component long")
    placed = written(known.join(nearest, "id").withColumn("asks", F.lit(True)))
    parts = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    inside = written(placed.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")))
    # both directions of a pair of blocks say the same
    pairs = written(_near_balls(inside, threshold).where("struct(c, i) <= struct(d, j)").distinct())
    sides = inside.select("space", "component", "part", "id", "v", "m")
    mine = sides.withColumnsRenamed({"component": "c", "part": "i"}).join(pairs, ["c", "i"]).withColumn("mine", F.lit(True))
    theirs = sides.withColumnsRenamed({"component": "d", "part": "j"}).join(pairs, ["d", "j"]).withColumn("mine", F.lit(False))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        ask = rows["mine"].to_numpy()
        x, ids, m, same = _unit(rows["v"]), rows["id"].to_numpy(), rows["m"].to_numpy(), np.array_equal(np.sort(rows["id"][ask]), np.sort(rows["id"][~ask]))
        near = (x[ask] @ x[~ask].T >= threshold) & (ids[ask][:, None] != ids[~ask][None])
        a, b = ids[ask], ids[~ask]
        most = np.iinfo(np.int64).max
        low_a, low_b, before = a.copy(), b.copy(), None
        while before is None or not np.array_equal(before, low_a):  # smallest ids run along the links until all rest
            before = low_a.copy()
            low_b = np.minimum(low_b, np.where(near, low_a[:, None], most).min(0, initial=most))
            low_a = np.minimum(low_a, np.where(near, low_b[None], most).min(1, initial=most))
        out = [pd.DataFrame({"id": a, "others": near @ m[~ask], "low": low_a})[near.any(1)]]
        if not same:
            out.append(pd.DataFrame({"id": b, "others": m[ask] @ near, "low": low_b})[near.any(0)])
        return pd.concat(out)

    met = written(mine.unionByName(theirs).groupBy("c", "i", "d", "j").applyInPandas(meet, "id long, others long, low long"))
    label = components(met.select("id", "low").distinct(), "id", "low").withColumnRenamed("id", "node")
    counted = met.groupBy("id").agg(F.sum("others").alias("others"))
    return counted.join(label, counted["id"] == label["node"]).select("id", "others", "component")


def recall(found: DataFrame, known: DataFrame, threshold: float, audited: int = AUDITED) -> float:
    """Links found over links there, of blocks of nodes in order of hash, from `audited` nodes on, until SEEN nodes with links are
    seen or all nodes are; a block's vectors go to every task."""
    ordered = known.withColumn("h", F.xxhash64("id"))
    there = hit = seen = 0
    rest, size = ordered, audited
    while seen < SEEN:
        block = rest.orderBy("h", "id").limit(size).select("h", "id", "space", "v").collect()
        if not block:
            break
        h, i = block[-1]["h"], block[-1]["id"]
        rest, size = ordered.where((F.col("h") > h) | (F.col("h") == h) & (F.col("id") > i)), min(2 * size, MOST_AUDITED)
        x = _audit(block, found, known, threshold)
        seen, there, hit = seen + x[0], there + (x[1] or 0), hit + (x[2] or 0)
    return hit / there if there else 1.0


def _audit(sample: list, found: DataFrame, known: DataFrame, threshold: float) -> tuple:
    """(nodes of the sample with links, their links, those found)."""
    spaces, ids = np.array([r["space"] for r in sample]), np.array([r["id"] for r in sample])
    vectors = {s: _unit(pd.Series([r["v"] for r in sample if r["space"] == s])) for s in set(spaces)}

    def count(batches):
        for batch in batches:
            for space, rows in batch.groupby("space"):
                if space in vectors:
                    mine = ids[spaces == space]
                    near = (vectors[space] @ _unit(rows["v"]).T >= threshold) & (mine[:, None] != rows["id"].to_numpy()[None])
                    yield pd.DataFrame({"id": mine, "n": near @ rows["m"].to_numpy()})

    there = known.mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where("n > 0")
    return there.join(found, "id", "left").agg(F.count("*"), F.sum("n"), F.sum(F.least("n", F.coalesce("others", F.lit(0))))).first()


def near_vectors(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    tell_workers(rows.sparkSession)
    members, known = nodes(rows)
    total, graph = known.count(), None
    best = 0.0
    for attempt in count():
        graph = graph_of(known, total, attempt, graph)
        found = written(links_of(graph, known, threshold))
        got = recall(found, known, threshold)
        if got >= RECALL:
            break
        if attempt >= ATTEMPTS - 1 and got <= best:
            found = written(exact_links(known, threshold))
            break
        best = max(best, got)
    label = known.select("id", "m").join(found, "id", "left").select("id", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    out = members.join(label, "id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
