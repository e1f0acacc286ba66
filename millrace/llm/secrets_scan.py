"""Secret scan with multipart credential linking (DataFrame functions only).

Patterns find strong secrets (always reported) and weak parts: identifiers,
opaque strings and endpoints that mean little alone.  Parts carry an interval
and the scope it lies in (a section between blank lines).  An interval join
inside the scope links identifiers to secrets: parts are put in order of
their starts, and two running passes give each part the nearest complementary one before and
behind it.  A weak part is reported only when that lies within ``reach`` code points.

All of it happens inside the row: positions come from the lengths of a text's
pieces between matches, so there is no shuffle and no pair is ever written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.carried import Carried

# The base kinds' patterns, in the order in which they are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

# Weak parts, of this scan's own.
IDENT = r"""(?i:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"

KINDS = ["assign", "access", "hex", "ident", "opaque", "endpoint"]
SCOPE_BREAK = r"\n[ \t\r]*\n"
SPAN = "struct<s:int,k:int,e:int,c:int>"
#: Items of one part of a running pass: what has been gathered is copied at each item, so parts stay short.
PART = 256


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state after each item of an array.

    States at the borders of parts of ``PART`` items come first, then those inside each part, so
    the cost stays near the number of items.
    """
    last = lambda states: F.element_at(states, -1)
    whole = lambda acc, part: F.concat(acc, F.array(F.aggregate(part, last(acc), step)))
    inner = lambda acc, x: F.concat(acc, F.array(step(last(acc), x)))
    within = lambda part, at: F.when(part.isNotNull(), F.slice(F.aggregate(part, F.array(at), inner), F.lit(2), F.size(part)))

    def parts(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / PART).cast("int"), F.lit(0))), lambda k: F.slice(v, k * PART + 1, F.lit(PART)))

    return _let(items, lambda v: _let(parts(v), lambda ps: F.flatten(F.array_compact(F.zip_with(ps, F.aggregate(ps, F.array(start), whole), within)))))


def _spans(text: Column, pattern: str, kind: int, value_of: int | None = None) -> Column:
    """Array of (start, kind, end, scope) of a pattern's matches in code points.

    The pieces between matches and the matches themselves alternate; running
    sums of their lengths are the positions, and blank lines among the pieces
    count the scopes (no match holds a line end).
    """
    value = (lambda h: F.length(F.regexp_extract(h, pattern, value_of))) if value_of else F.length
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, h: F.struct(
        F.length(p).alias("gap"),
        F.coalesce(F.length(h), F.lit(0)).alias("len"),
        F.coalesce(value(h), F.lit(0)).alias("vlen"),
        F.regexp_count(p, F.lit(SCOPE_BREAK)).alias("breaks"),
    ))
    state = lambda at, scope: F.struct(at.alias("at"), scope.alias("scope"))
    after = lambda v: running(v, state(F.lit(0), F.lit(0)), lambda acc, x: state(acc["at"] + x["gap"] + x["len"], acc["scope"] + x["breaks"]))
    span = lambda x, at: F.when(x["vlen"] >= (ASSIGN_VALUE if value_of else 1), F.struct((at["at"] - x["len"]).alias("s"), F.lit(kind).alias("k"), at["at"].alias("e"), at["scope"].alias("c")))
    found = _let(steps, lambda v: F.array_compact(F.zip_with(v, after(v), span)))
    return F.when(text.rlike(pattern), found).otherwise(_none())


def _backwards(items: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The state of a running pass from the end, at each item."""
    return F.reverse(running(F.reverse(items), start, step))


def _outside(spans: Column, others: Column) -> Column:
    """Spans that no span of others overlaps (of another kind than these)."""
    far, kind = F.lit(1 << 30), KINDS.index("opaque")
    is_other = lambda x: x["k"] != kind
    ends = lambda v: running(v, F.lit(-1), lambda acc, x: F.when(is_other(x), F.greatest(acc, x["e"])).otherwise(acc))
    starts = lambda v: _backwards(v, far, lambda acc, x: F.when(is_other(x), F.least(acc, x["s"])).otherwise(acc))
    free = lambda v, before, behind: F.filter(v, lambda x, i: ~is_other(x) & (F.get(before, i) <= x["s"]) & (F.get(behind, i) >= x["e"]))
    return _let(F.array_sort(F.concat(spans, others)), lambda v: _let(ends(v), lambda before: _let(starts(v), lambda behind: free(v, before, behind))))


def _linked(parts: Column, reach: int) -> Column:
    """Weak parts with their complement within reach in their scope; parts: in order of starts."""
    far = 1 << 30
    names = ["access", "ident"], ["assign", "hex", "opaque"]
    is_ident, is_secret = (lambda x, n=n: x["k"].isin([KINDS.index(k) for k in n]) for n in names)
    state = lambda i, ic, t, tc: F.struct(i.alias("i"), ic.alias("ic"), t.alias("t"), tc.alias("tc"))

    def step(acc: Column, x: Column) -> Column:
        new = lambda test, own, field: F.when(test(x), x[own]).otherwise(acc[field])
        return state(new(is_ident, "s", "i"), new(is_ident, "c", "ic"), new(is_secret, "s", "t"), new(is_secret, "c", "tc"))

    start = state(*[F.lit(v) for v in (far, -1, far, -1)])
    near = lambda at, x, place, scope: (at[scope] == x["c"]) & (F.abs(at[place] - x["s"]) <= reach)

    def chosen(before: Column, behind: Column, x: Column, i: Column) -> Column:
        ident = near(F.get(before, i), x, "i", "ic") | near(F.get(behind, i), x, "i", "ic")
        secret = near(F.get(before, i), x, "t", "tc") | near(F.get(behind, i), x, "t", "tc")
        kind = lambda name: x["k"] == KINDS.index(name)
        return (kind("ident") & secret) | (kind("opaque") & ident) | (kind("endpoint") & ident & secret)

    return _let(running(parts, start, step), lambda before: _let(_backwards(parts, start, step), lambda behind: F.filter(parts, lambda x, i: chosen(before, behind, x, i))))


RESULTS = ["base_spans", "linked_spans"]


def secret_scan(df: DataFrame, text: str = "text", reach: int = 400) -> DataFrame:
    """Add ``base_spans`` and ``linked_spans`` to ``df``.

    Both are arrays of (s, k, e, c): start, index in ``KINDS``, end (exclusive, code points), scope;
    ordered by start, then kind.  base_spans holds the strong kinds.
    linked_spans holds the weak ones whose complement starts in the same scope at
    most ``reach`` code points away: identifiers with a secret, opaque strings
    (outside of other spans) with an identifier, endpoints with both.

    Defined cases: a null text is empty and has no spans; texts are read whole;
    repeated rows and ties each keep their row; an empty table gives no rows;
    input columns with the names of results are replaced, others are carried whatever their names.
    """
    own = Carried(df, RESULTS)
    body = F.coalesce(F.col(own.find(text)).cast("string"), F.lit(""))
    found = own.rows.select(
        *own.columns(),
        F.array_sort(F.concat(_spans(body, ASSIGN, 0, 2), _spans(body, ACCESS, 1), _spans(body, HEX, 2))).alias("base"),
        _spans(body, IDENT, 3).alias("ident"),
        _spans(body, OPAQUE, 4).alias("opaque"),
        _spans(body, ENDPOINT, 5).alias("endpoint"),
    )
    free = F.when(F.size("opaque") > 0, _outside(F.col("opaque"), F.concat("base", "ident", "endpoint"))).otherwise(_none())
    found = found.select(*own.columns(), "base", F.array_sort(F.concat("base", "ident", free, "endpoint")).alias("parts"))
    weak = F.size("parts") > F.size("base")
    spans = found.select(*own.columns(), F.col("base").alias("base_spans"), F.when(weak, _linked(F.col("parts"), reach)).otherwise(_none()).alias("linked_spans"))
    return spans.select(*own.restored(), *RESULTS)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == KINDS.index(kind))).cast("long")
