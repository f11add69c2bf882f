"""Secret scans: fixed patterns, and a sliding window of Shannon entropy per character class over candidate strings.

All JVM expressions, local to a row: no shuffle. Spans are (start, end) in code points, end exclusive. A null text is empty and
has no spans; an empty table gives none; repeated rows get the same spans each. Spans of a kind never overlap; those of several
kinds that start together stand in the order of KINDS.

Very long texts: matches are placed and texts are cut in strips and blocks, and no pattern repeats a group, so the cost of a
text grows with its length (placing n matches copies n ** 1.5 references) and no depth of the regular expressions with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the contract. {n,} keeps whole runs, which is the same as dropping runs that are too short.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A text without any of these has no match of ASSIGN; looking for plain strings is much cheaper.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

#: What the entropy scan looks at: whole candidate strings, then, by character class, what '=' sets apart with its padding, and
#: runs of hex digits of either case.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
PARTS = (r"[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?", r"[0-9A-F]{20,}", r"[0-9a-f]{20,}")
#: The window, and bits a character from which a class is suspicious.
WINDOW = 20
THRESHOLDS = {"hex": 3.0, "base64": 3.7}
#: Strings that look random but are no secrets: numbers, words, UUIDs, test values (longer ones hold such words by chance); and
#: names and paths, by what their parts are.
SHORT = 128
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    rf"(?i)^(?=.{{0,{SHORT}}}$).*?(example|sample|dummy|placeholder|changeme|xxxx|0123456789|1234567890|abcdefgh)",
)
BETWEEN, FIRST_PART, PART = r"[-_/=]+", r"^[A-Za-z]*$", r"^([A-Za-z]{2,}|[0-9]{1,4})?$"
#: Characters that are cut or counted at once, so that nothing walks a long text from its start again and again.
STRIP = 4096
SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"

#: A count takes 5 bits, 12 counts a number; candidates' characters are the codes from '+' to 'z'.
_BITS, _PER, _FIRST = 5, 12, ord("+")
_NUMBERS = (ord("z") - _FIRST) // _PER + 1


def _strips(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{STRIP}}}', 0)"


def running(values: str, join: Callable[[str, str], str]) -> Column:
    """What ``join`` (of whole numbers from 0 up, associative, 0 is neutral) makes of each first part of the array ``values``.

    Arrays grow by copying, so the result is made in sqrt(n) blocks of sqrt(n).
    """
    n, none = f"size({values})", "cast(array() AS array<int>)"
    width = f"cast(ceil(sqrt({n})) AS int)"
    more = f"(acc, x) -> named_struct('at', {join('acc.at', 'x')}, 'out', concat(acc.out, array({join('acc.at', 'x')})))"
    block = f"aggregate(slice({values}, k * {width} + 1, {width}), named_struct('at', 0, 'out', {none}), {more})"
    blocks = f"transform(sequence(0, cast(ceil({n} / {width}) AS int) - 1), k -> {block})"
    shifted = f"transform(b.out, x -> {join('acc.at', 'x')})"
    put = f"(acc, b) -> named_struct('at', {join('acc.at', 'b.at')}, 'out', concat(acc.out, array({shifted})))"
    whole = f"aggregate({blocks}, named_struct('at', 0, 'out', cast(array() AS array<array<int>>)), {put}, acc -> flatten(acc.out))"
    return F.expr(f"CASE WHEN {n} > 0 THEN {whole} ELSE {none} END")


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _most(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def with_matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, int, Column]]) -> DataFrame:
    """``df`` with a column of spans for each name: (pattern, kind, possible). All matches from left to right, none where
    ``possible`` is false. Their places follow from the gaps of split()."""
    each = lambda f: {key: value for name in patterns for key, value in f(name).items()}
    df = df.withColumns(each(lambda n: {f"_g{n}": F.when(patterns[n][2], F.split(F.col(text), patterns[n][0], -1))}))
    df = df.withColumns(each(lambda n: {f"_h{n}": F.when(F.size(f"_g{n}") > 1, F.regexp_extract_all(F.col(text), F.lit(patterns[n][0]), F.lit(0)))}))
    df = df.withColumns(each(lambda n: {f"_s{n}": F.expr(f"zip_with(slice(_g{n}, 1, size(_h{n})), _h{n}, (g, h) -> length(g) + length(h))")}))
    df = df.withColumns(each(lambda n: {f"_e{n}": running(f"_s{n}", _sum)}))
    span = lambda n: f"named_struct('start', e - length(h), 'kind', {patterns[n][1]}, 'end', e, 'text', h)"
    df = df.withColumns(each(lambda n: {n: F.expr(f"CASE WHEN size(_h{n}) > 0 THEN zip_with(_h{n}, _e{n}, (h, e) -> {span(n)}) ELSE cast(array() AS {SPAN}) END")}))
    return df.drop(*(f"_{k}{n}" for k in "ghse" for n in patterns))


def with_gaps(df: DataFrame, name: str, text: str, spans: str) -> DataFrame:
    """``df`` with the places (start, end, text) of ``text`` outside the sorted ``spans``: one before each run of spans that
    overlap, empty if need be, and one after the last."""
    some = f"size({spans}) > 0"
    df = df.withColumns({"_to": F.expr(f"CASE WHEN {some} THEN transform({spans}, s -> s.end) END"), "_cut": F.expr(f"CASE WHEN {some} THEN {_strips(text)} END")})
    df = df.withColumn("_reach", running("_to", _most))
    gap = f"zip_with({spans}, concat(array(0), _reach), (s, r) -> named_struct('start', r, 'end', coalesce(s.start, length({text}))))"
    first, last = f"cast(g.start div {STRIP} AS int)", f"cast(g.end div {STRIP} AS int)"
    near = f"array_join(slice(_cut, {first} + 1, {last} - {first} + 1), '')"
    piece = f"named_struct('start', g.start, 'end', g.end, 'text', substr({near}, g.start % {STRIP} + 1, g.end - g.start))"
    # The size is asked for so that _cut is named twice: what is named once may be computed anew for each piece.
    gaps = f"CASE WHEN {some} AND size(_cut) >= 0 THEN transform(filter({gap}, g -> g.end >= g.start), g -> {piece}) END"
    return df.withColumn(name, F.expr(gaps)).drop("_to", "_reach", "_cut")


def blank_spans(df: DataFrame, text: str, spans: str) -> DataFrame:
    """``df`` with blanks for what ``spans`` cover in ``text``; its length stays."""
    df = with_gaps(df, "_around", text, spans)
    blanked = "array_join(zip_with(_around, slice(_around, 2, size(_around)), (g, h) -> concat(g.text, repeat(' ', coalesce(h.start - g.end, 0)))), '')"
    return df.withColumn(text, F.expr(f"CASE WHEN _around IS NULL THEN {text} ELSE {blanked} END")).drop("_around")


def window_entropy(s: str, window: int = WINDOW) -> str:
    """SQL of the largest Shannon entropy, in bits a character, of any ``window`` characters of ``s``; null if it is shorter.

    H = log2 w - (sum of n log2 n) / w. The counts of a window's characters are kept, packed; when the window moves on, that of
    the character that leaves goes down, that of the one that enters goes up, and the sum changes by these two terms.
    """
    n_log_n = [n * math.log2(n) if n > 1 else 0.0 for n in range(window + 2)]
    more = f"array({', '.join(f'{b - a!r}D' for a, b in zip(n_log_n, n_log_n[1:]))})"
    count = lambda c: f"cast(shiftright(get(acc.held, {c}.number), {c}.shift) & {2**_BITS - 1} AS int)"
    others = f"{count('x.in')} - if(x.in <=> x.out, 1, 0)"
    gone = f"coalesce(get({more}, {count('x.out')} - 1), 0D)"
    moved = "h + if(x.in.number = k, x.in.one, 0L) - if(x.out.number <=> k, x.out.one, 0L)"
    least = "if(x.out IS NULL, acc.least, least(acc.least, acc.sum))"
    step = f"named_struct('held', transform(acc.held, (h, k) -> {moved}), 'sum', acc.sum - {gone} + get({more}, {others}), 'least', {least})"
    begin = f"named_struct('held', array_repeat(0L, {_NUMBERS}), 'sum', 0D, 'least', double('inf'))"
    code = f"(ascii(c) - {_FIRST})"
    symbol = f"named_struct('number', cast({code} div {_PER} AS int), 'shift', {code} % {_PER} * {_BITS}, 'one', shiftleft(1L, {code} % {_PER} * {_BITS}))"
    symbols = f"transform(slice(split(strip, ''), 1, length(strip)), c -> {symbol})"
    # With each character the one that leaves the window for it.
    pairs = f"slice(zip_with(symbols, concat(array_repeat(cast(NULL AS struct<number:int,shift:int,one:bigint>), {window}), symbols), (a, b) -> named_struct('in', a, 'out', b)), 1, size(symbols))"
    scan = f"aggregate({pairs}, {begin}, (acc, x) -> {step}, acc -> least(acc.least, acc.sum))"
    of = f"if(length(strip) < {window}, NULL, array_min(transform(array({symbols}), symbols -> {scan})))"
    # A strip and the start of the next hold every window that begins in the strip.
    strips = f"zip_with({_strips(s)}, slice({_strips(s)}, 2, length({s})), (a, b) -> concat(a, coalesce(substr(b, 1, {window - 1}), '')))"
    return f"{math.log2(window)!r}D - array_min(transform({strips}, strip -> {of})) / {window}"


def _suspicious(spans: str) -> Column:
    """Those of ``spans`` that the allow list does not pass and that have a window of too much entropy."""
    quoted = lambda p: "r'" + p + "'"
    allowed = " OR ".join(f"s.text RLIKE {quoted(p)}" for p in ALLOWED)
    parts = f"split(s.text, {quoted(BETWEEN)})"
    name = f"size({parts}) > 1 AND get({parts}, 0) RLIKE {quoted(FIRST_PART)} AND forall(slice({parts}, 2, length(s.text)), p -> p RLIKE {quoted(PART)})"
    bits = f"if(s.text RLIKE '^([0-9a-f]+|[0-9A-F]+)$', {THRESHOLDS['hex']}D, {THRESHOLDS['base64']}D)"
    return F.expr(f"filter({spans}, s -> CASE WHEN {allowed} OR {name} THEN false ELSE {window_entropy('s.text')} >= {bits} END)")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (those and the entropy scan's), each sorted by start, then kind.

    What the fixed patterns report is blanked first, so the entropy scan looks at the rest only.
    """
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2))
    df = docs.withColumn("_rest", F.coalesce(F.col("text"), F.lit("")))
    # A match of ACCESS or HEX lies in a run that CANDIDATE finds, so the other passes are for the few texts with such a run.
    some = F.col("_some")
    keyword = reduce(lambda a, b: a | b, (F.lower(F.col("_rest")).contains(k) for k in KEYWORDS))
    df = df.withColumn("_some", F.col("_rest").rlike(CANDIDATE))
    df = with_matches(df, "_rest", {"_assign": (ASSIGN, 0, keyword), "_access": (ACCESS, 1, some), "_hex": (HEX, 2, some)})
    df = df.withColumn("base_spans", F.array_sort(F.concat(F.filter("_assign", lambda s: value(s) >= ASSIGN_LEAST), "_access", "_hex")))
    df = blank_spans(df, "_rest", "base_spans")
    levels = {f"_level{k}": (pattern, k, some) for k, pattern in enumerate((CANDIDATE, *PARTS))}
    df = with_matches(df, "_rest", levels)
    # A run of a class is part of what '=' sets apart, and that of a candidate: the widest that is suspicious is reported.
    df = df.withColumn("_new", F.array_sort(F.concat(*map(_suspicious, levels))))
    df = df.withColumn("_to", F.transform("_new", lambda s: s["end"])).withColumn("_reach", running("_to", _most))
    wide = "filter(zip_with(_new, concat(array(0), _reach), (s, r) -> named_struct('s', s, 'r', r)), x -> x.s.start >= x.r)"
    entropy = F.expr(f"transform({wide}, x -> named_struct('start', x.s.start, 'kind', {len(KINDS) - 1}, 'end', x.s.end, 'text', x.s.text))")
    return df.withColumn("spans", F.array_sort(F.concat("base_spans", entropy))).drop("_rest", "_some", "_assign", "_access", "_hex", *levels, "_new", "_to", "_reach")


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its text masked, spans that overlap by one mask; columns as before. Texts without spans stay as they are."""
    found = find_secrets(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    found = with_gaps(found, "_around", "text", "spans")
    masked = F.array_join(F.transform("_around", lambda g: g["text"]), mask)
    found = found.withColumn("masked", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("masked").alias(name)
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.size("spans") > 0, F.length("masked").cast(kind)).otherwise(F.col("row")[name]).alias(name)
        return F.col("row")[name].alias(name)

    return found.select(*map(column, docs.columns))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The figures of the contract from find_secrets()."""
    df = find_secrets(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return df.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written("base_spans").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans")
    )
