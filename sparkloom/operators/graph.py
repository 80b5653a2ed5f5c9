"""Questions about a directed graph: nodes (id) and edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators._size import cut, small


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst: distinct edges both of whose ends are nodes."""
    ids = small(nodes.select("id").distinct())
    e = edges.select("src", "dst").distinct()
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def callers(adj: DataFrame, of: DataFrame) -> DataFrame:
    """id, caller for the ids in ``of``."""
    return adj.join(small(of.select(F.col("id").alias("dst"))), "dst", "left_semi").select(F.col("dst").alias("id"), F.col("src").alias("caller"))


def callees(adj: DataFrame, of: DataFrame) -> DataFrame:
    """id, callee for the ids in ``of``."""
    return adj.join(small(of.select(F.col("id").alias("src"))), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("callee"))


def neighbours(adj: DataFrame) -> DataFrame:
    """src, dst both ways, distinct."""
    return adj.unionByName(adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(adj: DataFrame) -> DataFrame:
    """id, degree, n_in, n_out."""
    ends = adj.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(adj.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"), F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def k_hop(adj: DataFrame, start: DataFrame, depth: int, direction: str = "both", limit: int | None = None) -> DataFrame:
    """start, id, distance: nodes within ``depth`` steps; with a limit, the nearest ones by (distance, id)."""
    step = {"both": neighbours(adj), "out": adj, "in": adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}[direction]
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        new = front.select("start", F.col("id").alias("src")).join(step, "src").select("start", F.col("dst").alias("id")).distinct()
        front = new.join(seen, ["start", "id"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    if limit is not None:
        seen = seen.withColumn("_n", F.row_number().over(Window.partitionBy("start").orderBy("distance", "id"))).where(F.col("_n") <= limit).drop("_n")
    return seen


def distance_map(adj: DataFrame, seeds: DataFrame, usage: bool = False, fan_out: int = 50, depth: int = 2) -> DataFrame:
    """id, distance: nodes reached from any seed within two steps, following ``fan_out`` neighbours a node at most."""
    step = adj.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if usage else neighbours(adj)
    step = step.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= fan_out).drop("_n")
    seen = seeds.select(F.col("id").alias("seed"), "id").distinct()
    front, out = seen, None
    for d in range(1, depth + 1):
        new = front.select("seed", F.col("id").alias("src")).join(step, "src").select("seed", F.col("dst").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti")
        seen = seen.unionByName(new)
        hop = new.select("id", F.lit(d).alias("distance"))
        out = hop if out is None else out.unionByName(hop)
        front = new
    return out.groupBy("id").agg(F.min("distance").alias("distance"))


def paths(adj: DataFrame, pairs: DataFrame, max_depth: int = 5, limit: int | None = 20) -> DataFrame:
    """source, target, path: simple paths of up to ``max_depth`` edges for the pairs, the shortest and then smallest first.

    Paths grow level by level, each level one join; nodes from which no target can be reached in the steps that are
    left are not entered, so a level holds only what can still become an answer.
    """
    back = adj.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = k_hop(back, pairs.select(F.col("target").alias("id")).distinct(), max_depth, "out").select(F.col("start").alias("target"), "id", F.col("distance").alias("_left"))
    near = cut(near)  # met again at every level
    level = pairs.select("source", "target").distinct().select("source", "target", F.array("source").alias("path"), F.col("source").alias("end"))
    found = level.where("end = target").select("source", "target", "path")
    live = level.where("end != target")
    for d in range(1, max_depth + 1):
        grown = live.join(adj, live["end"] == adj["src"]).where(~F.array_contains("path", F.col("dst"))).select("source", "target", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        grown = grown.join(near, (grown["target"] == near["target"]) & (grown["end"] == near["id"]) & (near["_left"] <= max_depth - d), "left_semi")
        found = found.unionByName(grown.where("end = target").select("source", "target", "path"))
        live = grown.where("end != target")
    if limit is not None:
        order = Window.partitionBy("source", "target").orderBy(F.size("path"), "path")
        found = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return found


def shortest(found: DataFrame) -> DataFrame:
    """Of paths, those as short as the shortest of their pair."""
    least = F.min(F.size("path")).over(Window.partitionBy("source", "target"))
    return found.withColumn("_m", least).where(F.size("path") == F.col("_m")).drop("_m")


def cut_short(adj: DataFrame, pairs: DataFrame, max_depth: int, most: int = 10_000) -> DataFrame:
    """source, target of the pairs for which a search must leave something out.

    A search follows simple paths until they meet the target.  It leaves something out where a path of ``max_depth``
    edges could have gone on, or where more than ``most`` paths grow for a pair (such a pair is not followed further).
    """
    live = pairs.select("source", "target").distinct().where("source != target").select("source", "target", F.array("source").alias("path"), F.col("source").alias("end"))
    total = live.select("source", "target", F.lit(1).alias("n"))
    out = None
    for d in range(max_depth + 1):
        grown = live.join(adj, live["end"] == adj["src"]).where(~F.array_contains("path", F.col("dst"))).select("source", "target", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        grown = cut(grown)
        if d == max_depth:
            hit = grown.select("source", "target").distinct()
            return hit if out is None else out.unionByName(hit).distinct()
        total = total.unionByName(grown.groupBy("source", "target").agg(F.count("*").cast("int").alias("n"))).groupBy("source", "target").agg(F.sum("n").cast("int").alias("n"))
        over = total.where(F.col("n") > most).select("source", "target")
        out = over if out is None else out.unionByName(over)
        live = grown.where("end != target").join(over, ["source", "target"], "left_anti")


def statuses(adj: DataFrame, pairs: DataFrame, max_depth: int = 5, limit: int = 20) -> DataFrame:
    """source, target, status, n_paths: SEARCH_LIMIT_REACHED where a search for ``limit`` paths leaves something out, else
    SUPPORTED with paths, else NO_STATIC_PATH_FOUND."""
    found = paths(adj, pairs, max_depth, limit + 1).groupBy("source", "target").agg(F.count("*").alias("n"))
    short = cut_short(adj, pairs, max_depth).withColumn("_cut", F.lit(True))
    both = pairs.select("source", "target").distinct().join(found, ["source", "target"], "left").join(short, ["source", "target"], "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(F.col("_cut") | (n > limit), "SEARCH_LIMIT_REACHED").when(n > 0, "SUPPORTED").otherwise("NO_STATIC_PATH_FOUND")
    return both.select("source", "target", status.alias("status"), F.least(n, F.lit(limit)).alias("n_paths"))


def _spread(adj: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label: the smallest label of any node from which each can be reached (its own included)."""
    mark = None
    while True:
        new = labels.join(adj, labels["id"] == adj["src"]).groupBy("dst").agg(F.min("label").alias("_in"))
        labels = cut(labels.join(new, labels["id"] == new["dst"], "left").select("id", F.least("label", F.coalesce("_in", "label")).alias("label")))
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("id", "label").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return labels
        mark = tuple(now)


def strong_components(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    """id, component: the smallest node with which each is mutually reachable.

    By colouring: every node takes the smallest node that reaches it as its colour; the nodes of a colour that reach
    the colour's own node are its component and leave; the others go on.  Tables stay as large as the graph.
    """
    left, edges, out = cut(nodes.select("id").distinct()), adj, None
    while left.limit(1).count():
        colour = _spread(edges, left.select("id", F.col("id").alias("label"))).withColumnRenamed("label", "colour")
        same = edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("_a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), "dst").where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        start = colour.select("id", F.when(F.col("id") == F.col("colour"), F.col("colour")).alias("label"))
        home = _spread(cut(same), start).where("label is not null").select("id", F.col("label").alias("component"))
        out = home if out is None else out.unionByName(home)
        left = cut(left.join(home, "id", "left_anti"))
        edges = cut(edges.join(left.withColumnRenamed("id", "src"), "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return out if out is not None else nodes.select("id", F.col("id").alias("component"))


def layers(nodes: DataFrame, adj: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """id, component, level: the longest way to each component of the condensed graph."""
    comp = strong_components(nodes, adj)
    dag = adj.join(comp.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(comp.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").where("a != b").select("a", "b").distinct()
    level = comp.select("component").distinct().withColumn("level", F.lit(0))
    total = -1
    for _ in range(max_rounds):
        up = dag.join(level, dag["a"] == level["component"]).groupBy("b").agg((F.max("level") + 1).alias("l"))
        level = cut(level.join(up, level["component"] == up["b"], "left").select("component", F.greatest("level", F.coalesce("l", F.lit(0))).alias("level")))
        now = level.agg(F.coalesce(F.sum("level"), F.lit(0))).first()[0]
        if now == total:
            break
        total = now
    return comp.join(level, "component").select("id", "component", "level")


def file_map(edges: DataFrame, symbols: DataFrame, limit: int = 150) -> tuple[DataFrame, DataFrame]:
    """(files: file_path, degree, the most connected first; pairs: a, b) over cross-file edges."""
    at = symbols.select(F.col("symbol_id"), "file_path")
    pairs = edges.join(at.select(F.col("symbol_id").alias("src"), F.col("file_path").alias("a")), "src").join(at.select(F.col("symbol_id").alias("dst"), F.col("file_path").alias("b")), "dst").where("a != b").select("a", "b").distinct()
    deg = pairs.select(F.col("a").alias("file_path")).unionByName(pairs.select(F.col("b").alias("file_path"))).groupBy("file_path").agg(F.count("*").alias("degree"))
    files = symbols.select("file_path").distinct().join(deg, "file_path", "left").select("file_path", F.coalesce("degree", F.lit(0)).alias("degree"))
    return files.orderBy(F.desc("degree"), "file_path").limit(limit), pairs


def resolve(symbols: DataFrame, names: DataFrame, kinds: tuple[str, ...] = ("function", "arrow_function", "method", "test", "module")) -> DataFrame:
    """name, symbol_id, ambiguous: the callables that a name stands for: an id, else a short or qualified name; a class
    stands for its methods but the constructor."""
    by_id = names.join(symbols, names["name"] == symbols["symbol_id"]).select(names["name"], "symbol_id", "kind")
    rest = names.join(by_id.select("name"), "name", "left_anti")
    s = symbols.withColumnRenamed("name", "short")
    by_name = rest.join(s, (rest["name"] == s["short"])).select("name", "symbol_id", "kind").unionByName(rest.join(s, rest["name"] == s["qualified_name"]).select("name", "symbol_id", "kind")).distinct()
    hits = by_id.withColumn("ambiguous", F.lit(False)).unionByName(by_name.withColumn("ambiguous", F.count("*").over(Window.partitionBy("name")) > 1))
    own = hits.where(F.col("kind").isin(*kinds)).select("name", "symbol_id", "ambiguous")
    inner = s.where((F.col("short") != "constructor") & F.col("kind").isin(*kinds)).select(F.col("symbol_id").alias("inner"), "parent_symbol_id")
    members = hits.where("kind = 'class'").join(inner, F.col("symbol_id") == F.col("parent_symbol_id")).select("name", F.col("inner").alias("symbol_id"), "ambiguous")
    return own.unionByName(members).distinct()


def trace(symbols: DataFrame, adj: DataFrame, source: str, target: str, max_depth: int = 5, ends: int = 20, limit: int = 20) -> dict:
    """Status and up to ``limit`` paths between two named symbols.

    AMBIGUOUS_SYMBOL before all; SEARCH_LIMIT_REACHED if endpoints were cut or a search could have gone deeper;
    SUPPORTED with paths; else NO_STATIC_PATH_FOUND.
    """
    spark = symbols.sparkSession
    names = spark.createDataFrame([(source,), (target,)], "name string").distinct()
    hits = resolve(symbols, names).orderBy("name", "symbol_id").collect()  # the symbols of two names
    as_id, as_name = F.col("symbol_id") == F.col("asked"), (F.col("name") == F.col("asked")) | (F.col("qualified_name") == F.col("asked"))
    asked = symbols.select("symbol_id", "name", "qualified_name").join(F.broadcast(names.withColumnRenamed("name", "asked")), as_id | as_name)  # two names
    twice = asked.groupBy("asked").agg(F.count_if(as_id).alias("ids"), F.count_if(as_name).alias("n")).where("ids = 0 and n > 1")
    if twice.limit(1).count():
        return {"status": "AMBIGUOUS_SYMBOL", "paths": [], "max_depth": max_depth, "ids": []}
    a = [r["symbol_id"] for r in hits if r["name"] == source]
    b = [r["symbol_id"] for r in hits if r["name"] == target]
    short = len(a) > ends or len(b) > ends
    pairs = [(x, y) for x in a[:ends] for y in b[:ends]]
    found = []
    if pairs:
        ask = spark.createDataFrame(pairs, "source string, target string")
        got = paths(adj, ask, max_depth, limit)
        found = sorted([r["path"] for r in got.select("path").collect()], key=lambda p: (len(p), p))[:limit]  # limit a pair
        short = short or bool(statuses(adj, ask, max_depth, limit).where("status = 'SEARCH_LIMIT_REACHED'").limit(1).count())
    status = "SEARCH_LIMIT_REACHED" if short else "SUPPORTED" if found else "NO_STATIC_PATH_FOUND"
    return {"status": status, "paths": found, "max_depth": max_depth, "ids": sorted({s for p in found for s in p}) or sorted({*a, *b})[:30]}


def subgraph(symbols: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the symbols with the given ids (id) that can be called, and the edges between two of them."""
    ids = small(ids.select(F.col("id").alias("symbol_id")).distinct())
    nodes = symbols.where(F.col("kind") != "class").join(ids, "symbol_id", "left_semi").select("symbol_id", "qualified_name", "file_path", "start_line", "end_line", "kind")
    ends = small(nodes.select("symbol_id"))
    inside = edges.join(ends.withColumnRenamed("symbol_id", "src"), "src", "left_semi").join(ends.withColumnRenamed("symbol_id", "dst"), "dst", "left_semi")
    return nodes, inside.select(edges.columns)


def neighbourhood(adj: DataFrame, start: DataFrame, depth: int, limit: int = 150) -> tuple[DataFrame, DataFrame]:
    """(k_hop cut to the ``limit`` nearest; start, status: SEARCH_LIMIT_REACHED where some were cut, else OK)."""
    every = k_hop(adj, start, depth)
    order = Window.partitionBy("start").orderBy("distance", "id")
    near = every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    status = every.groupBy("start").agg(F.when(F.count("*") > limit, "SEARCH_LIMIT_REACHED").otherwise("OK").alias("status"))
    return near, status


def symbol_map(symbols: DataFrame, edges: DataFrame, file: str | None = None, limit: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first ``limit`` symbols that can be called, of one file or of all."""
    can = symbols.where(F.col("kind") != "class")
    can = can if file is None else can.where(F.col("file_path") == file)
    return subgraph(symbols, edges, can.orderBy("file_path", "start_line", "symbol_id").limit(limit).select(F.col("symbol_id").alias("id")))


def view(nodes: DataFrame, edges: DataFrame, text: str = "", selected: str | None = None, most: int = 60, most_edges: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that a drawing of a graph shows: names or files that hold ``text``, the selected node first, its
    neighbours next, then the others by id."""
    hits = nodes.where(F.contains(F.lower(F.concat_ws(" ", "qualified_name", "file_path")), F.lower(F.lit(text))))
    near = edges.where((F.col("src") == selected) | (F.col("dst") == selected)).select(F.explode(F.array("src", "dst")).alias("symbol_id")).distinct() if selected else nodes.select("symbol_id").limit(0)
    ranked = hits.join(near.withColumn("_near", F.lit(True)), "symbol_id", "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    shown = ranked.orderBy(F.col("symbol_id") != F.lit(selected or ""), ~F.col("_near"), "symbol_id").limit(most).drop("_near")
    ends = shown.select("symbol_id")
    inside = edges.join(F.broadcast(ends.withColumnRenamed("symbol_id", "src")), "src", "left_semi").join(F.broadcast(ends.withColumnRenamed("symbol_id", "dst")), "dst", "left_semi")  # at most ``most`` ids
    return shown, inside.select(edges.columns).orderBy("src", "dst").limit(most_edges)


def tree(files: DataFrame, prefix: str = "") -> DataFrame:
    """name, is_folder: what a folder of the paths (path) holds, folders first."""
    rest = files.where(F.col("path").startswith(prefix)).select(F.substring("path", len(prefix) + 1, 1 << 30).alias("r"))
    name = F.split("r", "/")[0]
    return rest.groupBy(name.alias("name")).agg(F.bool_or(F.contains("r", F.lit("/"))).alias("is_folder")).orderBy(F.desc("is_folder"), "name")
