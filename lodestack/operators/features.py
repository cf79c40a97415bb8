"""What a function is worth before any query: size, branching, rank, words, shape, place in the API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rounded

#: Keywords and builtins of Python 3.13 and generic names, in lower case: data, so that results don't depend on the interpreter; a parameter of informative().
STOP_WORDS = """
    __build_class__ __debug__ __doc__ __import__ __loader__ __name__ __package__ __spec__ _incompleteinputerror abs aiter all and anext any args
    arithmeticerror as ascii assert assertionerror async attributeerror await baseexception baseexceptiongroup bin blockingioerror bool break breakpoint
    brokenpipeerror buffererror bytearray bytes byteswarning callable childprocesserror chr class classmethod cls compile complex connectionabortederror
    connectionerror connectionrefusederror connectionreseterror continue copyright credits data def del delattr deprecationwarning dict dir divmod elif
    ellipsis else encodingwarning enumerate environmenterror eoferror eval except exception exceptiongroup exec exit false fileexistserror
    filenotfounderror filter finally float floatingpointerror for format from frozenset futurewarning generatorexit getattr global globals hasattr hash
    help hex id if import importerror importwarning in indentationerror indexerror input int interruptederror ioerror is isadirectoryerror isinstance
    issubclass item items iter key keyboardinterrupt keyerror keys kwargs lambda len license list locals lookuperror map max memoryerror memoryview min
    modulenotfounderror nameerror next none nonlocal not notadirectoryerror notimplemented notimplementederror obj object objs oct open or ord oserror out
    output overflowerror pass pendingdeprecationwarning permissionerror pow print processlookuperror property pythonfinalizationerror quit raise range
    recursionerror referenceerror repr resourcewarning result ret return reversed round runtimeerror runtimewarning self set setattr slice sorted
    staticmethod stopasynciteration stopiteration str sum super syntaxerror syntaxwarning systemerror systemexit taberror timeouterror tmp true try tuple
    type typeerror unboundlocalerror unicodedecodeerror unicodeencodeerror unicodeerror unicodetranslateerror unicodewarning userwarning val vals value
    valueerror values vars warning while with yield zerodivisionerror zip
""".split()
WEIGHTS = {"cc": 0.25, "loc": 0.15, "pr": 0.25, "tfidf": 0.15, "struct": 0.15, "api": 0.05}
CAPS = {"loc": 200.0, "cc": 20.0, "tfidf": 2.0}


def informative(token: Column, stop: list[str] | None = None) -> Column:
    """Not a keyword, builtin or generic word, not a dunder or underscores alone, two characters at least."""
    stop = STOP_WORDS if stop is None else stop
    dunder = F.startswith(token, F.lit("__")) & F.endswith(token, F.lit("__"))
    return (F.length(token) >= 2) & ~F.lower(token).isin(*stop) & ~dunder & (F.replace(token, F.lit("_"), F.lit("")) != "")


def term_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, token, n of rows (key, token), combined before they are sent; plans that hold it twice send it once."""
    return rows.groupBy(key, "token").agg(F.count("*").alias("n"))


def identifier_idf(rows: DataFrame, n: int | Column, key: str = "qname") -> DataFrame:
    """token, df, idf = ln((N + 1) / (df + 1)) + 1 over rows (key, token); case matters."""
    return term_counts(rows, key).groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.greatest(F.lit(n) if isinstance(n, int) else n, F.lit(1)) + 1) / (F.col("df") + 1)) + 1)


def mean_idf(rows: DataFrame, idf: DataFrame, key: str = "qname") -> DataFrame:
    """key, tfidf: the sum over tokens of share x idf, which is the mean idf of its occurrences; unknown tokens count 1."""
    one = term_counts(rows, key).join(idf.select("token", "idf"), "token", "left")
    return one.groupBy(key).agg((F.sum(F.col("n") * F.coalesce("idf", F.lit(1.0))) / F.sum("n")).alias("tfidf"))


def structure_richness(pairs: Column, size: Column) -> Column:
    return F.least(F.lit(1.0), pairs / (F.log2(size + 1) + 5))


def capped(x: Column, cap: float) -> Column:
    return F.least(F.lit(1.0), x / cap)


def api_boost(symbols: DataFrame, exports: DataFrame, main_calls: DataFrame) -> DataFrame:
    """qname, api: 0.2 each for a public top-level function, one that is exported, one that the main guard calls; 0.5 at most."""
    e = exports.select("path", "name").distinct().withColumn("__e", F.lit(1))
    m = main_calls.select("path", "name").distinct().withColumn("__m", F.lit(1))
    public = (F.col("depth") == 0) & (F.col("name") != "") & ~F.startswith(F.col("name"), F.lit("_"))
    hits = F.when(public, 1).otherwise(0) + F.coalesce("__e", F.lit(0)) + F.coalesce("__m", F.lit(0))
    return symbols.select("path", "qname", "name", "depth").join(e, ["path", "name"], "left").join(m, ["path", "name"], "left").select("qname", F.least(F.lit(0.5), hits * 0.2).alias("api"))


def base_score(f: dict[str, Column] | None = None) -> Column:
    """The weighted sum of the six features (loc, cc, pr, tfidf, struct, api), to 4 decimals."""
    c = {k: F.coalesce(F.col(k), F.lit(0.0)) for k in WEIGHTS} | (f or {})
    parts = {"cc": capped(c["cc"], CAPS["cc"]), "loc": capped(c["loc"], CAPS["loc"]), "pr": c["pr"], "tfidf": capped(c["tfidf"], CAPS["tfidf"]), "struct": c["struct"], "api": 2 * c["api"]}
    return rounded(sum((w * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0)), 4)


def features(symbols: DataFrame, ranks: DataFrame, tfidf: DataFrame, api: DataFrame) -> DataFrame:
    """qname with the six features; ranks over their maximum, missing ones 0.

    To 12 digits: what the order of summing leaves beyond them would decide how scores are rounded that lie on a half.
    """
    top = F.broadcast(ranks.agg(F.max("rank").alias("__top")))
    pr = ranks.crossJoin(top).select("qname", F.when(F.col("__top") > 0, rounded(F.col("rank") / F.col("__top"), 12)).otherwise(0.0).alias("pr"))
    own = symbols.select("qname", "loc", "cc", structure_richness(F.col("struct_pairs"), F.col("struct_size")).alias("struct"))
    joined = own.join(pr, "qname", "left").join(tfidf, "qname", "left").join(api, "qname", "left")
    return joined.fillna(0.0, ["pr", "tfidf", "struct", "api"])
