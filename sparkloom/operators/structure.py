"""Repository structure: symbols, chunks and resolved calls from source files.

One task reads a file and notes what stands there: symbols with the scopes around them, calls, exports, imports, names
that a scope hides or binds, names that are written again.  What a call means is then found by joins of these tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.javascript import CALLABLE, COMPUTED, MODULE, File, read
from sparkloom.functions.text import WORD_CHAR
from sparkloom.operators._size import saved

SYMBOL = "struct<symbol_id:string,qualified_name:string,name:string,kind:string,file_path:string,start_line:int,end_line:int,start_byte:long,end_byte:long,parent_symbol_id:string,source_text:string,content_hash:string,parameters:array<string>,is_test:boolean,method_kind:string,comments:array<string>,scopes:array<string>>"
CALL = "struct<source:string,callee:string,callee_type:string,class:string,line:int,end_line:int,start_byte:long,end_byte:long,expression:string,statement_byte:long,sequence_eligible:boolean>"
FACTS = {
    "symbols": SYMBOL,
    "calls": CALL,
    "exports": "struct<key:string,symbol_id:string>",
    "imports": "struct<alias:string,module:string,member:string,supported:boolean,cjs:boolean>",
    "hidden": "struct<scope:string,name:string>",
    "bound": "struct<scope:string,name:string,made:string>",
    "rewritten": "string",
}
SCHEMA = "path string, has_errors boolean, " + ", ".join(f"{k} array<{v}>" for k, v in FACTS.items())


def _facts(f: File) -> dict:
    """The rows of one file, one list a table."""
    around: dict[str | None, list[str]] = {None: [MODULE]}
    for s in f.symbols:  # outer ones come first
        around[s["symbol_id"]] = [*around[s["parent_symbol_id"]], s["symbol_id"]]
    return {
        "symbols": [s | {"scopes": around[s["symbol_id"]]} for s in f.symbols],
        "calls": f.calls,
        "exports": [{"key": k, "symbol_id": v} for k, v in f.exports.items() if v],
        "imports": [{"alias": a, "module": i["module"], "member": i["name"], "supported": i["supported"], "cjs": i["cjs"]} for a, i in sorted(f.imports.items())],
        "hidden": [{"scope": scope, "name": n} for scope, names in f.shadowed.items() for n in sorted(names)],
        "bound": [{"scope": scope, "name": n, "made": v} for scope, names in f.bindings.items() for n, v in names.items()],
        "rewritten": sorted({n for names in f.reassigned.values() for n in names}),
    }


def parse(files: DataFrame) -> DataFrame:
    """One row per file (path, source): whether it has errors, and the tables of FACTS as arrays."""

    def run(batches):
        for pdf in batches:
            read_ = [read(path, source) for path, source in zip(pdf["path"], pdf["source"], strict=True)]
            rows = [(f.path, f.has_errors, *_facts(f).values()) for f in read_]
            yield pd.DataFrame(rows, columns=["path", "has_errors", *FACTS])

    return files.select("path", "source").mapInPandas(run, SCHEMA)


def _table(parsed: DataFrame, fact: str) -> DataFrame:
    return parsed.select(F.col("path").alias("file"), F.explode(fact).alias("f")).select("file", "f" if fact == "rewritten" else "f.*")


def symbols(parsed: DataFrame) -> DataFrame:
    """All symbols."""
    return _table(parsed, "symbols").drop("file", "scopes")


def chunks(parsed: DataFrame) -> DataFrame:
    """Callables with the text that they are searched by: path, name, imports that the source uses, source."""
    s = parsed.select("imports", F.explode("symbols").alias("s")).select("imports", "s.*").drop("scopes").where(F.col("kind").isin(*CALLABLE))
    used = F.filter("imports.alias", lambda n: F.regexp_like("source_text", F.concat(F.lit(f"(^|[^{WORD_CHAR[1:-1]}])\\Q"), n, F.lit(f"\\E($|[^{WORD_CHAR[1:-1]}])"))))
    text = F.concat_ws("\n", "file_path", "qualified_name", F.array_join(used, " "), "comments", "source_text")
    return s.select(F.col("symbol_id").alias("doc_id"), "file_path", "qualified_name", "kind", "start_line", "end_line", F.col("source_text"), text.alias("text"), "content_hash", "is_test")


def module_paths(path: Column, module: Column) -> Column:
    """Paths that a relative module may stand for in the file at ``path``, in order; none for other modules."""
    none = F.array().cast("array<string>")
    parts = F.split(F.concat(F.regexp_replace(path, "[^/]*$", ""), module), "/")

    def walk(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))

    at = F.array_join(F.aggregate(parts, none, walk), "/")
    bare = F.array(F.concat(at, F.lit(".js")), F.concat(at, F.lit("/index.js")))
    return F.when(~module.startswith("."), none).when(at.endswith(".js"), F.array(at)).when(at.rlike(r"(^|/)\.*[^./][^/]*\.[^/]*$"), none).otherwise(bare)


def requests(parsed: DataFrame) -> DataFrame:
    """One row per call with what it asks for.

    ``name`` is to be looked up through ``scopes``; or ``holder`` is the class that must have the method; or ``alias``
    is an import whose ``key`` is wanted.  ``method`` is wanted of the class that was found; ``reason`` tells why a
    call asks for nothing.
    """
    sym, bound = _table(parsed, "symbols"), _table(parsed, "bound")
    calls = _table(parsed, "calls").withColumnRenamed("class", "in_class")
    calls = calls.join(parsed.select(F.col("path").alias("file"), "has_errors"), "file").withColumn("call", F.concat_ws("|", "file", "start_byte", "end_byte"))
    by_name, by_member = F.col("callee_type") == "identifier", F.col("callee_type") == "member_expression"
    calls = calls.withColumns({
        "receiver": F.when(by_member, F.regexp_extract("callee", r"^(.*)\.[^.]*$", 1)), "member": F.when(by_member, F.regexp_extract("callee", r"\.([^.]*)$", 1)),
    }).withColumns({"alias": F.when(by_name, F.col("callee")).otherwise(F.col("receiver")), "held": F.when(F.col("receiver") == "this", F.col("callee")).otherwise(F.col("receiver"))})

    callers = sym.select(F.col("symbol_id").alias("source"), F.col("scopes").alias("caller_scopes"), F.col("method_kind").alias("caller_kind"), F.col("parent_symbol_id").alias("outer"))
    outers = sym.select(F.col("symbol_id").alias("outer"), (F.col("kind") != "class").alias("nested"))
    classes = sym.select(F.col("symbol_id").alias("in_class"), F.col("scopes").alias("class_scopes"))
    made = bound.select("file", F.col("scope").alias("in_class"), F.col("name").alias("held"), "made")
    computed = bound.where(F.col("name") == COMPUTED).select("file", F.col("scope").alias("in_class"), F.lit(True).alias("computed"))
    imports = _table(parsed, "imports").withColumnRenamed("member", "imported")
    veiled = _table(parsed, "hidden").select("file", F.col("scope").alias("source"), F.col("name").alias("alias"), F.lit(True).alias("veiled"))
    c = calls.join(callers, "source", "left").join(outers, "outer", "left").join(classes, "in_class", "left")
    c = c.join(made, ["file", "in_class", "held"], "left").join(computed, ["file", "in_class"], "left").join(imports, ["file", "alias"], "left").join(veiled, ["file", "source", "alias"], "left")

    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    on_self = F.col("receiver") == "this"
    on_module = (F.col("imported") == "*") & F.col("supported") & ~no("veiled")
    on_field = F.col("receiver").startswith("this.") & F.col("in_class").isNotNull()
    case = (
        F.when(F.col("has_errors"), "error").when((F.col("caller_kind") != "normal") | (no("nested") & ~by_name), "scope")
        .when(by_name, "name").when(~by_member, "none")
        .when(on_self, F.when(F.col("made").isNotNull() | no("computed") | F.col("in_class").isNull(), "none").otherwise("self"))
        .when(on_module, "module").when(on_field, F.when(no("computed"), "computed").when(F.col("made") != "", "field").otherwise("none")).otherwise("none")
    )
    c = c.withColumn("case", case)
    is_ = lambda *x: F.col("case").isin(*x)
    module_style = F.when(F.col("cjs"), "commonjs_require")
    # fixed values: how an edge was resolved, and why a call was not
    how = (
        F.when(is_("name"), F.concat(F.coalesce(module_style, F.when(F.col("imported").isNotNull(), "named_or_default_import"), F.lit("lexical_scope")), F.when(no("nested"), "_nested").otherwise("")))
        .when(is_("self"), "same_class_method").when(is_("module"), F.coalesce(module_style, F.lit("namespace_import"))).when(is_("field"), "constructor_instance")
    )
    reason = F.when(is_("error"), "PARSE_ERROR").when(is_("scope"), "UNSUPPORTED_SCOPE").when(is_("computed"), "COMPUTED_WRITE").otherwise("UNRESOLVED")
    return c.select(
        "call", "file", "source", "callee", "line", "end_line", "start_byte", "end_byte", "expression", "statement_byte", "sequence_eligible", how.alias("how"), reason.alias("reason"),
        F.when(is_("name"), F.col("callee")).when(is_("field"), F.col("made")).alias("name"), F.when(is_("name"), F.col("caller_scopes")).when(is_("field"), F.col("class_scopes")).alias("scopes"),
        F.when(is_("self"), F.col("in_class")).alias("holder"), F.when(is_("module"), F.col("alias")).alias("alias"), F.when(is_("module"), F.col("member")).alias("key"),
        F.when(is_("self", "field"), F.col("member")).alias("method"),
    )


def declarations(parsed: DataFrame) -> DataFrame:
    """file, scope, name, n, symbol_id, hidden: how many symbols a scope declares by a name, one of them, and whether the
    scope hides outer ones (parameters, variables)."""
    named = _table(parsed, "symbols").select("file", F.coalesce("parent_symbol_id", F.lit(MODULE)).alias("scope"), "name", "symbol_id")
    hidden = _table(parsed, "hidden").select("file", "scope", "name", F.lit(None).cast("string").alias("symbol_id"))
    return named.unionByName(hidden).groupBy("file", "scope", "name").agg(F.count("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"), F.bool_or(F.col("symbol_id").isNull()).alias("hidden"))


def look_up(asked: DataFrame, parsed: DataFrame) -> DataFrame:
    """call, symbol_id, alias: the symbol or the import that a name (call, file, name, scopes) stands for, if it is sure.

    The innermost declaring or hiding scope below the module decides; only without one do imports and the module's
    own symbols count.  Names that are written again anywhere in the file stand for nothing.
    """
    steps = asked.select("call", "file", "name", F.posexplode("scopes").alias("depth", "scope"))
    met = steps.join(declarations(parsed), ["file", "scope", "name"])
    inner, top = F.col("depth") > 0, F.col("depth") == 0
    best = met.groupBy("call").agg(F.max(F.when(inner, F.struct("depth", "n", "symbol_id"))).alias("inner"), F.max(F.when(top, F.struct("n", "symbol_id", "hidden"))).alias("top"))
    imports = _table(parsed, "imports").select("file", F.col("alias").alias("name"), "supported", "cjs")
    rewritten = _table(parsed, "rewritten").select("file", F.col("f").alias("name")).distinct()
    full = asked.select("call", "file", "name").join(rewritten, ["file", "name"], "left_anti").join(best, "call", "left").join(imports, ["file", "name"], "left")
    n_top = F.coalesce("top.n", F.lit(0))
    veil = F.coalesce("top.hidden", F.lit(False)) & (n_top == 0) & ~F.coalesce("cjs", F.lit(False))
    outside = F.col("inner").isNull() & ~veil
    symbol = F.when(F.col("inner.n") == 1, F.col("inner.symbol_id")).when(outside & F.col("supported").isNull() & (n_top == 1), F.col("top.symbol_id"))
    return full.select("call", symbol.alias("symbol_id"), F.when(outside & F.col("supported"), F.col("name")).alias("alias")).where("symbol_id is not null or alias is not null")


def imported(asked: DataFrame, parsed: DataFrame) -> DataFrame:
    """call, symbol_id: what the file behind an import exports (call, file, alias, key; a null key is the import's own).

    Of the paths that a module may stand for, the first that is there counts, if it was read without errors.
    """
    imports = _table(parsed, "imports").select("file", "alias", "module", "member", "cjs")
    wanted = asked.join(imports, ["file", "alias"]).select("call", F.coalesce("key", "member").alias("key"), "cjs", F.posexplode(module_paths(F.col("file"), F.col("module"))).alias("at", "there"))
    files = parsed.select(F.col("path").alias("there"), "has_errors")
    first = wanted.join(files, "there").groupBy("call").agg(F.min(F.struct("at", "there", "has_errors", "key", "cjs")).alias("m")).where("not m.has_errors").select("call", F.col("m.there").alias("file"), "m.key", "m.cjs")

    kept = declarations(parsed).where((F.col("scope") == MODULE) & (F.col("n") == 1)).select("file", F.col("name").alias("key"), F.lit(True).alias("one"))
    again = _table(parsed, "rewritten").select("file", "f").distinct()
    own = _table(parsed, "symbols").select("symbol_id", F.col("name").alias("own_name"), F.col("parent_symbol_id").isNull().alias("outermost"))
    exports = _table(parsed, "exports").join(own, "symbol_id").join(kept, ["file", "key"], "left")
    exports = exports.join(again.select("file", F.col("f").alias("key"), F.lit(True).alias("key_again")), ["file", "key"], "left").join(again.select("file", F.col("f").alias("own_name"), F.lit(True).alias("name_again")), ["file", "own_name"], "left")
    exports = exports.select("file", "key", "symbol_id", (F.col("one").isNotNull() & F.col("key_again").isNull()).alias("by_name"), (F.col("outermost") & F.col("name_again").isNull()).alias("by_require"))
    return first.join(exports, ["file", "key"]).where(F.when(F.col("cjs"), F.col("by_require")).otherwise(F.col("by_name"))).select("call", "symbol_id")


def resolve_calls(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): src, dst, how and place of calls whose target is known without doubt; the others' reasons.

    Files are read once: what they hold, what calls ask for and what they resolve to are written tables.
    """
    parsed = saved(parsed)
    asked = saved(requests(parsed))
    local = saved(look_up(asked.where("name is not null").select("call", "file", "name", "scopes"), parsed))
    foreign = asked.join(local.where("alias is not null").select("call", F.col("alias").alias("_alias")), "call", "left").select("call", "file", F.coalesce("alias", "_alias").alias("alias"), "key").where("alias is not null")
    found = local.where("symbol_id is not null").select("call", "symbol_id").unionByName(imported(foreign, parsed)).unionByName(asked.where("holder is not null").select("call", F.col("holder").alias("symbol_id")))

    sym = _table(parsed, "symbols").select("symbol_id", "name", "kind", "parent_symbol_id", "method_kind")
    callable_ = F.col("kind").isin(*CALLABLE)
    methods = sym.where(callable_).groupBy(F.col("parent_symbol_id").alias("symbol_id"), F.col("name").alias("method")).agg(F.count("*").alias("n"), F.min("symbol_id").alias("m"), F.min("method_kind").alias("k")).where("n = 1 and k = 'normal'")
    found = found.join(sym.select("symbol_id", "kind"), "symbol_id").join(asked.select("call", "method"), "call")
    plain = found.where(F.col("method").isNull() & callable_).select("call", F.col("symbol_id").alias("target"))
    of_class = found.where("kind = 'class'").join(methods, ["symbol_id", "method"]).select("call", F.col("m").alias("target"))
    done = saved(asked.join(plain.unionByName(of_class), "call", "left").withColumnRenamed("file", "call_file"))
    edges = done.where("target is not null").select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("CALLS").alias("edge_type"), "call_file", "line", "end_line", "start_byte", "end_byte", "expression", "how", "statement_byte", "sequence_eligible", F.array(F.lit("STATIC_VERIFIED")).alias("evidence_sources"))
    return edges, done.where("target is null").select("call_file", "source", "callee", "line", "expression", "reason")


def sequences(edges: DataFrame) -> DataFrame:
    """caller, before, after, before_line, after_line: resolved calls in separate statements of one body, in their order."""
    e = edges.where("sequence_eligible")
    a = e.select(F.col("src").alias("caller"), F.col("dst").alias("before"), F.col("line").alias("before_line"), F.col("statement_byte").alias("x"))
    b = e.select(F.col("src").alias("caller"), F.col("dst").alias("after"), F.col("line").alias("after_line"), F.col("statement_byte").alias("y"))
    return a.join(b, "caller").where("x < y").select("caller", "before", "after", "before_line", "after_line", F.lit("LEXICAL_BEFORE").alias("relation"))


def corroborate(edges: DataFrame, observed: DataFrame, source: str = "TS_LANGUAGE_SERVICE") -> DataFrame:
    """Edges with a further source of evidence where another tool saw the same call (src, dst, start_byte); none are added."""
    seen = observed.select("src", "dst", "start_byte").distinct().withColumn("_seen", F.lit(True))
    both = edges.join(seen, ["src", "dst", "start_byte"], "left")
    return both.withColumn("evidence_sources", F.when(F.col("_seen"), F.array_append("evidence_sources", F.lit(source))).otherwise(F.col("evidence_sources"))).drop("_seen")


def innermost(points: DataFrame, spans: DataFrame, width: int = 4096) -> DataFrame:
    """path, at, symbol_id: the smallest span (path, symbol_id, start_byte, end_byte) around each point (path, at).

    Spans are dealt to bins of ``width`` bytes, so that the range join is an equi-join on (path, bin).
    """
    s = spans.select("path", "symbol_id", "start_byte", "end_byte", F.explode(F.sequence(F.floor(F.col("start_byte") / width), F.floor((F.col("end_byte") - 1) / width))).alias("bin"))
    p = points.withColumn("bin", F.floor(F.col("at") / width))
    hit = p.join(s, ["path", "bin"]).where("start_byte <= at and at < end_byte")
    return hit.groupBy("path", "at").agg(F.min_by("symbol_id", F.struct(F.col("end_byte") - F.col("start_byte"), F.col("symbol_id"))).alias("symbol_id"))
