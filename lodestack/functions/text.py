"""Tokens, query expansion and lexical scores as column expressions.

Every function takes a column (or its name) and stays inside the JVM. Null texts count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a search for a key also looks for.
SYNONYMS = {
    "lr": ["learning", "rate", "learningrate"],
    "step": ["steps", "iteration", "iter", "epoch", "update"],
    "train": ["trainer", "training", "fit", "optimize"],
    "batch": ["batches", "minibatch", "minibatches"],
    "save": ["checkpoint", "dump", "persist", "serialize"],
    "eval": ["evaluate", "evaluation", "test", "metric", "validation"],
    "loader": ["dataloader", "iterator", "dataset"],
    "config": ["cfg", "args", "hyperparam", "hyperparameters"],
    "schedule": ["scheduler", "warmup", "cosine", "anneal", "decay"],
}
#: Endings that the keyword stemmer cuts, the first that fits.
ENDINGS = ("ing", "ers", "er", "ed", "ies", "s")


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def found(c: Column | str, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(_text(c), F.lit(pattern), F.lit(0))


def identifiers(c: Column | str) -> Column:
    """Lower-case tokens that start with a letter or underscore."""
    return found(F.lower(_text(c)), "[A-Za-z_][A-Za-z0-9_]*")


def alnum_tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.transform(found(c, "[A-Za-z0-9_]+"), F.lower)


def field_tokens(c: Column | str) -> Column:
    """The same runs, by splitting at everything else."""
    return F.filter(F.split(F.lower(_text(c)), "[^a-z0-9_]+"), lambda t: t != "")


def normalized(c: Column | str) -> Column:
    """Dotted lower-case names, each followed by its dotted parts and then its underscored parts, without repeats."""

    def parts(t: Column) -> Column:
        dotted = F.when(F.contains(t, F.lit(".")), F.filter(F.split(t, r"\."), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
        scored = F.when(F.contains(t, F.lit("_")), F.filter(F.split(t, "_"), lambda p: p != "")).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(t), dotted, scored)

    return F.array_distinct(F.flatten(F.transform(F.transform(found(c, r"[A-Za-z0-9_.]+"), F.lower), parts)))


def terms(c: Column | str) -> Column:
    """The set of identifiers and of their alphabetic runs, sorted."""
    tokens = identifiers(c)
    pieces = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.concat(tokens, pieces)))


def expanded(c: Column | str) -> Column:
    """terms() with synonyms and with a last s, ing and ed cut: one round, a sorted set; may hold the empty string."""
    own = terms(c)
    table = F.create_map(*(x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    synonyms = F.flatten(F.transform(own, lambda t: F.coalesce(F.element_at(table, t), F.array().cast("array<string>"))))

    def without(ending: str) -> Column:
        return F.transform(F.filter(own, lambda t: F.endswith(t, F.lit(ending))), lambda t: F.substring(t, F.lit(1), F.length(t) - len(ending)))

    cut = map(without, ("s", "ing", "ed"))
    return F.array_sort(F.array_distinct(F.concat(own, synonyms, *cut)))


def stemmed(t: Column) -> Column:
    """A word in lower case without the first ending that leaves more than two letters."""
    fits = lambda e: F.endswith(t, F.lit(e)) & (F.length(t) > len(e) + 2)
    return F.lower(reduce(lambda rest, e: F.when(fits(e), F.substring(t, F.lit(1), F.length(t) - len(e))).otherwise(rest), reversed(ENDINGS), t))


def keywords(c: Column | str) -> Column:
    """Identifiers, their camel-case pieces and underscored parts, stemmed, without repeats."""

    def pieces(t: Column) -> Column:
        camel = F.transform(F.regexp_extract_all(t, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0)), F.lower)
        return F.concat(F.array(t), camel, F.filter(F.split(t, "_"), lambda p: p != ""))

    # pieces follow all identifiers' own pieces, identifier by identifier
    return F.array_distinct(F.transform(F.flatten(F.transform(found(c, "[A-Za-z_][A-Za-z0-9_]*"), pieces)), stemmed))


def coverage(text: Column | str, wanted: Column, distinct: bool = True) -> Column:
    """The share of wanted terms that occur in the lower-case text as substrings; 0 without terms."""
    wanted = F.array_distinct(wanted) if distinct else wanted
    low = F.lower(_text(text))
    hits = F.size(F.filter(wanted, lambda t: (t != "") & F.contains(low, F.lower(t))))
    return F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(F.lit(0.0))


def passes(text: Column | str, wanted: Column, least: float) -> Column:
    """The lexical gate: true if least isn't positive, nothing is wanted, or enough of it is covered."""
    if least <= 0:
        return F.lit(True)
    return (F.size(wanted) == 0) | (coverage(text, wanted) >= least)


def word_tokens(c: Column | str) -> Column:
    """Lower-case Unicode words."""
    return found(F.lower(_text(c)), r"(?U)\w+")


def rounded(c: Column, digits: int = 6) -> Column:
    """Half-up rounding by the same arithmetic that SQL uses: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two number arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float = 1e-12) -> Column:
    """Cosine with epsilon added to each norm, so that a zero vector gives 0."""
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def unit(a: Column, epsilon: float = 1e-12) -> Column:
    """The vector over its norm plus epsilon; the norm is worked out once."""
    return F.transform(F.array(norm(a) + epsilon), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]
