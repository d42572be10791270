"""JSON inside pages that is no JSON document: chunks of a stream, and an array somewhere in a longer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quote that ends a string: an even number of backslashes stands before it.
ENDS = r'(?<!(?<!\\)(?:\\\\){0,50}\\)"'
# Fixed value: how one framework streams its state.
CHUNK = r'(?s)self\.__next_f\.push\(\[1,(".*?' + ENDS + r")\]\)"


def streamed_text(markup: Column, pattern: str = CHUNK) -> Column:
    """The string literals that pattern finds (group 1), decoded and joined in their order; those that are no JSON strings are left out."""
    literals = F.regexp_extract_all(markup, F.lit(pattern), 1)
    return F.array_join(F.transform(literals, lambda c: F.from_json(F.concat(F.lit('{"c":'), c, F.lit("}")), "c string")["c"]), "")


def array_text(blob: Column, name: str) -> Column:
    """The text of the JSON array that follows "name": in blob, or null where there is none or it does not end.

    Its end is where the running depth of brackets is zero again. Brackets in strings do not count, and a backslash takes the character after it along, so any
    depth and any text inside will do."""
    marker = f'"{name}":['

    def step(acc: Column, piece: Column) -> Column:
        going = acc["end"] == 0
        quote = going & (piece == '"')
        inside = acc["inside"] != quote
        change = F.when(inside | ~going, 0).when(piece.isin("[", "{"), 1).when(piece.isin("]", "}"), -1).otherwise(0)
        closed = going & (change == -1) & (acc["depth"] == 1)
        return F.struct((acc["depth"] + change).alias("depth"), inside.alias("inside"), (acc["n"] + 1).alias("n"), F.when(closed, acc["n"] + 1).otherwise(acc["end"]).alias("end"))

    def tail(b: Column) -> Column:
        at = F.position(F.lit(marker), b)
        return F.when(at > 0, F.substr(b, at + F.lit(len(marker) - 1)))

    begin = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("n"), F.lit(0).alias("end"))
    pieces = lambda t: F.regexp_extract_all(t, F.lit(r'(?s)(\\.|["\[\]{}]|[^"\\\[\]{}]+)'), 1)
    cut = lambda ps: F.slice(ps, 1, F.aggregate(ps, begin, step, lambda acc: acc["end"]))
    # Steps through an array of one entry: what they find is bound, not run again at every use.
    bound = F.array(F.col(blob) if isinstance(blob, str) else blob)
    for each in (tail, pieces, cut, lambda ps: F.nullif(F.array_join(ps, ""), F.lit(""))):
        bound = F.transform(bound, each)
    return bound[0]


def array_objects(blob: Column, name: str, ddl: str) -> Column:
    """The objects of that array as structs of ddl; what is no object is left out, and an array that is no JSON has none."""
    items = F.coalesce(F.from_json(array_text(blob, name), "array<string>"), F.array().cast("array<string>"))
    objects = F.filter(items, lambda x: x.startswith("{"))
    return F.transform(objects, lambda x: F.from_json(x, ddl))
