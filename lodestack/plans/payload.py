"""From parsed files and queries to the payload that a model reads.

Three plans share the operators: retrieval within single files, retrieval over a repository by
static scores blended with BM25, and hybrid retrieval by rank fusion with a lexical gate.
Queries are a table (query_id, query); heavy columns (code, source) are joined to what was chosen only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bm25, chunk, embed, features, graph, parse, rank, select
from ..operators.tables import cut
from ..sources.code import file_module

BODY_CAP, CLASS_CAP = 120, 10
NODE = ("type", "name", "qname", "module", "path", "lineno", "end_lineno", "signature", "docstring", "score")


def file_documents(parsed: DataFrame, variables: bool = False) -> DataFrame:
    """The documents of single-file retrieval: top-level symbols with their bags of tokens and their order.

    With variables, those of the module too: documents of a name alone, after all others, whose span is empty.
    """
    one = parse.top_level(parsed)
    if variables:
        own = parse.variables(parsed).select("path", "module", F.lit("variable").alias("kind"), "name", (F.col("ord") + (1 << 20)).alias("ord"), F.col("name").alias("signature"), F.lit("").alias("body_docstring"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"))
        one = one.unionByName(own, allowMissingColumns=True)
    one = one.withColumn("module", file_module(F.col("path"))).withColumn("body_calls", F.coalesce("body_calls", F.array().cast("array<string>")))
    qname = F.concat_ws("::", "module", "name")
    ids = F.transform(F.coalesce("body_identifiers", F.array().cast("array<string>")), F.lower)
    bag = F.concat(T.normalized("name"), T.normalized(qname), T.normalized("body_docstring"), ids, T.normalized("signature"))
    return one.select("path", "module", "kind", "name", qname.alias("qname"), "ord", "start_byte", "end_byte", "lineno", "end_lineno", "signature", F.nullif("body_docstring", F.lit("")).alias("docstring"), "body_calls", "code", bag.alias("tokens"), F.concat_ws("#", "path", F.format_string("%08d", "ord")).alias("doc_id"))


def semantic_rerank(pool: DataFrame, docs: DataFrame, queries: DataFrame, encode: embed.Encoder) -> DataFrame:
    """pool (query_id, doc_id, score, rank) with score half the old one and half the cosine to the query's vector, ranked anew."""
    some = pool.select("doc_id").distinct().join(docs, "doc_id")
    shown = embed.document_text(F.col("qname"), F.col("signature"), F.col("docstring"), F.encode("code", "UTF-8"))
    dv = embed.embedded(some.select("doc_id", shown.alias("text")), "doc_id", "text", encode).withColumnRenamed("v", "dv")
    qv = embed.embedded(queries.select("query_id", "query"), "query_id", "query", encode).withColumnRenamed("v", "qv")
    both = pool.drop("rank").join(dv, "doc_id").join(qv, "query_id").withColumn("similarity", T.cosine(F.col("qv"), F.col("dv")))
    return bm25.top_k(both.select("query_id", "doc_id", rank.reranked_half(both).alias("score")), (1 << 31) - 1)


def call_basenames(docs: DataFrame) -> DataFrame:
    """src (doc_id), callee, ord: last parts of called names, each once, in order of first call."""
    one = docs.select("path", F.col("doc_id").alias("src"), F.posexplode("body_calls").alias("ord", "c"))
    return one.withColumn("callee", F.element_at(F.split("c", r"\."), -1)).groupBy("path", "src", "callee").agg(F.min("ord").alias("ord"))


def node(score: Column, kind: str = "kind") -> Column:
    """A chosen symbol as the payload shows it."""
    return F.struct(F.col(kind).alias("type"), "name", "qname", "module", "path", "lineno", "end_lineno", "signature", "docstring", score.alias("score"))


def from_files(parsed: DataFrame, sources: DataFrame, queries: DataFrame, top_k: int = 6, prefilter: int = 300, depth: int = 1, max_add: int = 12, hard_cap: int = 1200, soft_cap: int = 1800, tokens: str = "bytes4", encode: embed.Encoder | None = None, variables: bool = False) -> DataFrame:
    """query_id, payload: the best top-level symbols of the files, their callees, and the code of both.

    Symbols added by the walk have no score. top_k 0 chooses nothing, and the code is then that of whole files.
    With encode, the prefilter's symbols are ranked by half their score and half their similarity to the query.
    """
    docs = file_documents(parsed, variables)
    asked = queries.select("query_id", T.normalized("query").alias("tokens"))
    most = max(1, prefilter if encode else min(prefilter, top_k))
    pool = bm25.top_k(bm25.okapi(asked, docs, every=True, top=most), most).filter(F.col("rank") <= prefilter)
    if encode:
        pool = semantic_rerank(pool, docs, queries, encode)
    pool = pool.filter(F.col("rank") <= top_k)
    seeds = pool.select("query_id", F.col("doc_id").alias("qname"), F.col("rank").alias("pos"), "score")
    calls = call_basenames(docs)
    # a walk looks at no more matches of a callee than its list has room for: a name's first definitions are enough
    targets = docs.select("path", F.col("name").alias("callee"), F.col("doc_id").alias("dst"))
    targets = select.first_k(targets, ["path", "callee"], max(0, top_k) + max(0, max_add), ["dst"])
    edges = calls.join(targets, ["path", "callee"]).select("src", "dst", "ord", "callee")
    chosen = graph.expanded(seeds, edges, depth, max_add).join(seeds.select("query_id", "qname", "score"), ["query_id", "qname"], "left")
    rows = chosen.withColumnRenamed("qname", "doc_id").join(docs.drop("tokens", "body_calls"), "doc_id")
    if top_k <= 0:
        parts = queries.select("query_id").crossJoin(sources.select("path", F.rtrim(F.decode("src", "UTF-8"), F.lit("\n")).alias("code")))
    else:
        spans = F.collect_list(F.struct(F.col("start_byte").alias("start"), F.col("end_byte").alias("end"), F.col("code").alias("text")))
        parts = chunk.code_of(rows.groupBy("query_id", "path").agg(spans.alias("spans")), ["query_id", "path"], hard_cap, soft_cap, tokens)
    code = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "code"))), lambda x: x["code"]), "\n").alias("code"))
    nodes = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", node(F.col("score")).alias("node")))).alias("n")).select("query_id", F.transform("n", lambda x: x["node"]).alias("nodes"))
    whole = queries.select("query_id").join(nodes, "query_id", "left").join(code, "query_id", "left")
    return whole.select("query_id", F.to_json(envelope(F.coalesce("nodes", F.array().cast("array<struct<type:string,name:string,qname:string,module:string,path:string,lineno:int,end_lineno:int,signature:string,docstring:string,score:double>>")), "code")).alias("payload"))


def envelope(nodes: Column, code: str | None = None, classes: Column | None = None) -> Column:
    """summary, nodes, classes, selected, code."""
    of = lambda kind: F.transform(F.filter(nodes, lambda x: x["type"] == kind), lambda x: x["qname"])
    extra = F.array().cast("array<string>") if classes is None else F.transform(classes, lambda c: c["qname"])
    fields = [F.struct(F.size(of("function")).alias("total_functions"), (F.size(of("class")) + F.size(extra)).alias("total_classes")).alias("summary"), nodes.alias("nodes")]
    if classes is not None:
        fields.append(classes.alias("classes"))
    fields.append(F.struct(F.transform(nodes, lambda x: x["qname"]).alias("roots"), of("function").alias("functions"), F.concat(of("class"), extra).alias("classes")).alias("selected"))
    if code:
        fields.append(F.col(code).alias("code"))
    return F.struct(*fields)


def static_scores(parsed: DataFrame, fixed: int | None = None) -> DataFrame:
    """Every function with its six features and its base score."""
    functions = parse.symbols(parsed, "function")
    edges = graph.call_edges(parse.call_sites(parsed), functions)
    ranks = graph.pagerank(functions.select("qname"), edges, fixed=fixed)
    words = functions.select("qname", F.explode("identifiers").alias("token")).filter(features.informative(F.col("token")))
    n = functions.count()
    tfidf = features.mean_idf(words, features.identifier_idf(words, n))
    api = features.api_boost(functions, parse.exports(parsed), parse.main_calls(parsed))
    return features.features(functions, ranks, tfidf, api).withColumn("base", features.base_score())


def repo_scores(parsed: DataFrame, base: DataFrame, queries: DataFrame, weight: float = 0.5) -> DataFrame:
    """query_id, qname, score: the base score blended with BM25 over name, qname and path; an empty query leaves the base.

    Functions meet the stated queries where they lie, with their base scores beside them.
    """
    functions = parse.symbols(parsed, "function").join(base.select("qname", "base"), "qname")
    docs = functions.select("qname", "base", T.identifiers(F.concat_ws(" ", "name", "qname", "path")).alias("tokens"))
    asked = queries.select("query_id", T.identifiers("query").alias("tokens"))
    every = bm25.bm25(asked, docs, doc_key="qname", keep=["base"], every=True).join(F.broadcast(queries.select("query_id", "query")), "query_id")
    blank = F.coalesce(F.col("query"), F.lit("")) == ""
    return every.select("query_id", "qname", F.when(blank, F.col("base")).otherwise(rank.blended(F.col("base"), F.col("score"), weight)).alias("score"))


def class_closure(parsed: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, qname, hop of the classes that chosen functions (query_id, qname) refer to.

    By a name in their code that is a class of the module; by the types that their annotations
    name; and, one hop, by those that these classes' annotations name.
    """
    functions = parse.symbols(parsed, "function").select("qname", "path", "lineno", "end_lineno", "code")
    classes = parse.symbols(parsed, "class").select(F.col("qname").alias("cls"), "path", F.col("name").alias("cls_name"), F.col("lineno").alias("c_from"), F.col("end_lineno").alias("c_to"))
    own = chosen.select("query_id", "qname").distinct().join(functions, "qname")
    # a name in the code is one of its words: an equality join instead of a pattern for each pair
    words = own.select("query_id", "path", F.explode(F.array_distinct(T.found("code", r"(?U)\w+"))).alias("cls_name"))
    by_name = words.join(classes, ["path", "cls_name"]).select("query_id", "cls")
    notes = parse.annotations(parsed).withColumnRenamed("type_name", "cls_name").select("path", F.col("lineno").alias("n_from"), F.col("end_lineno").alias("n_to"), "cls_name")
    inside = (F.col("n_from") >= F.col("lineno")) & (F.col("n_to") <= F.col("end_lineno"))
    by_type = own.drop("code").join(notes, "path").filter(inside).select("query_id", "path", "cls_name").join(classes, ["path", "cls_name"]).select("query_id", "cls")
    first = by_name.union(by_type).distinct()
    bodies = first.join(classes, "cls").select("query_id", "path", F.col("c_from").alias("lineno"), F.col("c_to").alias("end_lineno"))
    second = bodies.join(notes, "path").filter(inside).select("query_id", "path", "cls_name").join(classes, ["path", "cls_name"]).select("query_id", "cls")
    hops = first.withColumn("hop", F.lit(1)).union(second.withColumn("hop", F.lit(2)))
    return hops.groupBy("query_id", F.col("cls").alias("qname")).agg(F.min("hop").alias("hop"))


def assembled(parsed: DataFrame, chosen: DataFrame) -> DataFrame:
    """query_id, code: by path, the module's imports, then chosen classes, then chosen functions, in the order of the source."""
    symbols = parse.symbols(parsed).select("qname", "path", "kind", "start_byte", "code")
    picked = chosen.select("query_id", "qname").distinct().join(symbols, "qname")
    imports = parse.imports(parsed).filter("top_level").groupBy("path", "stmt", "rendered").agg(F.min("ord").alias("o")).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "rendered"))), lambda x: x["rendered"]), "\n").alias("imports"))
    parts = picked.groupBy("query_id", "path").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "class", 0).otherwise(1).alias("k"), "start_byte", "code"))).alias("p")).join(imports, "path", "left")
    text = F.concat_ws("\n\n", F.array_compact(F.array("imports")), F.transform("p", lambda x: x["code"]))
    return parts.select("query_id", "path", text.alias("t")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda x: x["t"]), "\n\n").alias("code"))


def from_repo(parsed: DataFrame, queries: DataFrame, top_k: int = 50, depth: int = 0, weight: float = 0.5, include_code: bool = False, base: DataFrame | None = None) -> DataFrame:
    """query_id, payload: the top_k functions by blended score; classes they refer to if depth; their code if asked for."""
    base = static_scores(parsed) if base is None else base
    scores = repo_scores(parsed, base, queries, weight)
    best = bm25.top_k(scores, max(1, top_k), doc_key="qname")
    functions = parse.symbols(parsed, "function").select("kind", "name", "qname", "module", "path", "lineno", "end_lineno", "signature", "docstring")
    nodes = best.join(functions, "qname").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", node(F.col("score")).alias("node")))).alias("n")).select("query_id", F.transform("n", lambda x: x["node"]).alias("nodes"))
    kind = "array<struct<type:string,name:string,qname:string,module:string,path:string,lineno:int,end_lineno:int,bases:string,docstring:string>>"
    chosen = best.select("query_id", "qname")
    if depth > 0:
        closure = class_closure(parsed, chosen)
        classes = parse.symbols(parsed, "class").select("qname", F.struct(F.col("kind").alias("type"), "name", "qname", "module", "path", "lineno", "end_lineno", "bases", "docstring").alias("c"))
        found = closure.join(classes, "qname").groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("classes"))
        nodes = nodes.join(found, "query_id", "left").withColumn("classes", F.coalesce("classes", F.array().cast(kind)))
        chosen = chosen.union(closure.select("query_id", "qname"))
    else:
        nodes = nodes.withColumn("classes", F.array().cast(kind))
    if include_code:
        nodes = nodes.join(assembled(parsed, chosen), "query_id", "left")
    return nodes.select("query_id", F.to_json(envelope(F.col("nodes"), "code" if include_code else None, F.col("classes"))).alias("payload"))


def rich_documents(parsed: DataFrame) -> DataFrame:
    """qname, tokens: name, signature, identifiers and the first tokens of the body."""
    one = parse.symbols(parsed, "function")
    head = T.identifiers(F.concat_ws(" ", "name", "signature", F.concat_ws(" ", "identifiers")))
    return one.select(F.col("qname").alias("doc_id"), F.concat(head, F.slice(T.identifiers("code"), 1, BODY_CAP)).alias("tokens"))


def hybrid_candidates(parsed: DataFrame, base: DataFrame, queries: DataFrame, weight: float = 0.5, least: float = 0.0, k: int = 60, encode: embed.Encoder | None = None) -> DataFrame:
    """query_id, key, final, lex_rank, passes of every function: BM25 over rich documents, fused, blended with the base score, gated.

    With encode, the similarity of functions' texts to the query is a second channel of the fusion.
    """
    asked = queries.select("query_id", T.expanded("query").alias("tokens"))
    functions = parse.symbols(parsed, "function")
    docs = rich_documents(parsed).join(base.select(F.col("qname").alias("doc_id"), "base"), "doc_id").withColumnRenamed("doc_id", "key")
    every = bm25.bm25(asked, docs, doc_key="key", keep=["base"], every=True).withColumn("score", T.rounded(F.col("score")))
    one = rank.ranked_whole(every, ["query_id"])
    fused = F.lit(1.0) / (k + F.col("rank") + 1)
    if encode:
        texts = functions.select(F.col("qname").alias("key"), F.concat_ws(" ", "name", "signature", F.concat_ws(" ", "identifiers"), "code").alias("text"))
        dense = rank.ranked_whole(embed.similarities(embed.embedded(texts, "key", "text", encode), queries, encode).withColumn("similarity", T.rounded(F.col("similarity"))), ["query_id"], score="similarity")
        one = one.join(dense.select("query_id", "key", F.col("rank").alias("dense_rank")), ["query_id", "key"], "left")
        fused += F.coalesce(F.lit(1.0) / (k + F.col("dense_rank") + 1), F.lit(0.0))
    shown = functions.select(F.col("qname").alias("key"), F.concat_ws(" ", "qname", "signature", "docstring").alias("shown"))
    wanted = queries.select("query_id", T.alnum_tokens(F.concat_ws(" ", T.expanded("query"))).alias("want"))
    one = one.withColumn("final", rank.blended(F.col("base"), fused, weight)).join(shown, "key").join(F.broadcast(wanted), "query_id")
    return one.select("query_id", "key", "final", F.col("rank").alias("lex_rank"), T.passes("shown", F.col("want"), least).alias("passes"))


def seeds_and_expanded(scores: DataFrame, functions: DataFrame, queries: DataFrame, edges: DataFrame, top_k: int, depth: int, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(query_id, qname, final, pos) of the seeds, and of the widened list: gated by coverage, widened both ways, ranked again, cut to top_k.

    scores: query_id, qname, final; functions: qname, code; queries: query_id, query. The gate asks for the
    share of the query's Unicode words, repeats counted, that a function's code holds; a query without words passes all.
    """
    rows = scores
    if least > 0:
        wanted = F.broadcast(queries.select("query_id", T.word_tokens("query").alias("want")))
        rows = scores.join(functions.select("qname", "code"), "qname").join(wanted, "query_id")
        rows = rows.filter((F.size("want") == 0) | (T.coverage("code", F.col("want"), distinct=False) >= least)).select("query_id", "qname", "final")
    best = Window.partitionBy("query_id").orderBy(F.desc("final"), "qname")
    seeds = cut(rows.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= top_k))
    if top_k <= 0 or depth <= 0:
        return seeds, seeds
    near = graph.within_depth(seeds.select("query_id", "qname"), edges, depth, ["query_id"]).select("query_id", "qname")
    wide = near.join(scores.select("query_id", "qname", "final"), ["query_id", "qname"], "left").fillna(0.0, ["final"])
    return seeds, wide.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= top_k)


def from_hybrid(parsed: DataFrame, base: DataFrame, queries: DataFrame, top_k: int = 8, depth: int = 1, weight: float = 0.5, least: float = 0.0, max_tokens: int | None = None, encode: embed.Encoder | None = None) -> DataFrame:
    """query_id, payload: gated seeds, widened along the call graph while there is room; ten classes of their modules at most; code within 4 x max_tokens characters."""
    candidates = cut(hybrid_candidates(parsed, base, queries, weight, least, encode=encode))
    seeds = rank.gated_seeds(candidates, ["query_id"], top_k, least).withColumnRenamed("key", "qname")
    functions = parse.symbols(parsed, "function")
    edges = graph.both_ways(graph.call_edges(parse.call_sites(parsed), functions))
    scores = candidates.select("query_id", F.col("key").alias("qname"), "final")
    walk = graph.fused_walk(seeds.select("query_id", "qname", "pos"), edges, scores, depth, top_k).join(scores, ["query_id", "qname"])
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "qname")
    picked = walk.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top_k).join(functions, "qname")
    nodes = picked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", node(F.col("final")).alias("node")))).alias("n")).select("query_id", F.transform("n", lambda x: x["node"]).alias("nodes"))
    classes = parse.symbols(parsed, "class").join(picked.select("query_id", "path").distinct(), "path")
    classes = select.first_k(classes, ["query_id"], CLASS_CAP, ["path", "ord"]).select("query_id", F.struct(F.col("kind").alias("type"), "name", "qname", "module", "path", "lineno", "end_lineno", "bases", "docstring").alias("c"))
    found = classes.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("classes"))
    whole = nodes.join(found, "query_id", "left").withColumn("classes", F.coalesce("classes", F.array().cast(found.schema["classes"].dataType)))
    if max_tokens is not None:
        fit = select.prefix(picked.withColumn("size", F.length("code")), ["query_id"], 4 * max_tokens, ["r"])
        code = fit.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "code"))), lambda x: x["code"]), "\n\n").alias("code"))
        whole = whole.join(code, "query_id", "left").fillna("", ["code"])
    return whole.select("query_id", F.to_json(envelope(F.col("nodes"), "code" if max_tokens is not None else None, F.col("classes"))).alias("payload"))
