"""Secret scan with DataFrame functions only.

Three base patterns (assignments, access keys, long hex runs) are found leftmost
and without overlap, each kind by itself.  The scan adds spans found by entropy:
candidate strings of one character class (hex, base64) are read with a window of
``window`` characters.  The window's Shannon entropy is kept up by incremental
counts: with S the sum of c*log2(c) over the window's character counts c, a step
changes two counts, and the entropy is log2(window) - S/window.  Windows at or
over the class's threshold are merged into spans.  Candidates that match an
allow-list pattern as a whole (plain words, numbers, path-like or repeated text)
are suppressed.  What an allow-list pattern without anchor (examples) finds is cut
out, with the letters and digits around it, and the rest of the candidate is read;
candidates, and rests, under ``window`` characters have no window.  Base spans are
never suppressed.

Positions come from the lengths of the pieces between matches (``split``) and of
the matches themselves (``regexp_extract_all``), both from the same matcher.
All work is within a row: no shuffle, no group; it grows in proportion to the text,
however long a run or however many the matches.

Defined results: null text counts as empty; a row without secrets has counts 0,
empty ``spans`` and the SHA-256 of the empty string; repeated rows come out
repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Class: (characters, entropy in bits at which a window counts).
CLASSES = {
    "entropy_hex": ("0-9a-fA-F", 3.0),
    "entropy_base64": ("A-Za-z0-9+/_=-", 4.0),
}
#: Candidates that match one of these hold no secret; without ^, only the letters and digits around the match hold none.
ALLOWED = [
    r"^[A-Za-z]+$",  # plain words, however long
    r"^[0-9]+$",  # numbers
    r"^[A-Z]?+[a-z]++(?:[-_/=+][A-Z]?+[a-z]++)*+$",  # compound words and paths; possessive, so long ones are read in a loop
    r"^(.{1,8})\1{2,}.{0,8}$",  # a short string over and over
    r"(?i)example|0123456789|abcdefghij",
]
WINDOW = 24
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Elements of an array that are gone through together.
BLOCK = 256


def _sql(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _before(values: str, identity: int, step) -> str:
    """SQL over an int array: of each element, what ``step`` makes of all elements before it.

    Blocks of elements are summed up first and then gone through from their own beginnings, so arrays that grow
    element by element stay short, and the work stays in proportion to the elements.
    """
    block = f"slice({values}, cast(k * {BLOCK} + 1 as int), {BLOCK})"
    of_block = f"aggregate({block}, {identity}, (a, x) -> {step('a', 'x')})"
    blocks = f"if(size({values}) = 0, cast(array() as array<int>), transform(sequence(0, cast((size({values}) - 1) div {BLOCK} as int)), k -> {of_block}))"

    def through(elements: str, first: str) -> str:
        return f"""aggregate({elements}, named_struct('at', {first}, 'out', cast(array() as array<int>)),
                     (s, x) -> named_struct('at', {step('s.at', 'x')}, 'out', array_append(s.out, s.at)), s -> s.out)"""

    return f"flatten(transform({through(blocks, str(identity))}, (first, k) -> {through(block, 'first')}))"


def _sum(a: str, b: str) -> str:
    return f"{a} + {b}"


def _located(df: DataFrame, out: str, pattern: str, value_group: int = 0, least: int = 0) -> DataFrame:
    """Add ``out``: (start, end, val) of all leftmost matches whose ``value_group`` has ``least`` characters."""
    p = _sql(pattern)
    none = "cast(array() as array<string>)"
    df = df.withColumn("has", F.col("text").rlike(pattern))
    df = df.withColumns({
        "gap": F.expr(f"if(has, split(text, {p}, -1), {none})"),
        "hit": F.expr(f"if(has, regexp_extract_all(text, {p}, 0), {none})"),
        "val": F.expr(f"if(has, regexp_extract_all(text, {p}, {value_group}), {none})"),
    })
    df = df.withColumn("sizes", F.expr("zip_with(gap, hit, (g, h) -> char_length(g) + coalesce(char_length(h), 0))"))
    df = df.withColumn("at", F.expr(_before("sizes", 0, _sum)))
    spans = f"""
      filter(transform(arrays_zip(gap, hit, val, at), x -> named_struct(
               'start', x.at + char_length(x.gap), 'end', x.at + char_length(x.gap) + char_length(x.hit), 'val', x.val)),
             x -> char_length(x.val) >= {least})"""
    return df.withColumn(out, F.expr(spans)).drop("has", "gap", "hit", "val", "sizes", "at")


def _without(pattern: str, least: int) -> str:
    """SQL over a candidate ``c``: its pieces of at least ``least`` characters around the words that hold the pattern.

    The pattern alone is looked for; the letters and digits beside a match are then trimmed off the gaps.
    """
    p = _sql(pattern)
    left = f"if(i = 0, x.gap, trim(LEADING '{LETTERS}' FROM x.gap))"
    piece = f"""
      transform(array({left}), l -> transform(array(if(i = size(gaps) - 1, l, trim(TRAILING '{LETTERS}' FROM l))), v -> named_struct(
        'start', c.start + x.at + char_length(x.gap) - char_length(l),
        'end', c.start + x.at + char_length(x.gap) - char_length(l) + char_length(v), 'val', v, 'cut', true))[0])[0]"""
    return f"""
      if(not c.val rlike {p}, array(c),
        flatten(transform(array(split(c.val, {p}, -1)), gaps ->
          flatten(transform(array(zip_with(gaps, regexp_extract_all(c.val, {p}, 0), (g, h) -> char_length(g) + coalesce(char_length(h), 0))), sizes ->
            filter(transform(zip_with(gaps, {_before("sizes", 0, _sum)}, (g, a) -> named_struct('gap', g, 'at', a)), (x, i) -> {piece}),
                   v -> char_length(v.val) >= {least}))))))"""


def _high_entropy(window: int, threshold: float) -> str:
    """SQL over a candidate ``c`` (start, end, val): merged spans of its windows with enough entropy.

    The counts of the window's characters are the characters of a string, 32 standing for none: a step
    replaces two of them.
    """
    # Sums of c*log2(c) are kept in millionths, so that increments are exact; what one more of a character adds:
    table = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(window + 1)]
    more = f"array({', '.join(f'{after - before}L' for before, after in zip(table, table[1:], strict=False))})"
    most = math.floor(1e6 * window * (math.log2(window) - threshold))
    steps = f"""
      transform(sequence(0, size(codes)),
        i -> named_struct('i', i, 'inn', coalesce(get(codes, i), -1), 'out', coalesce(get(codes, i - {window}), -1)))"""

    def count(of: str) -> str:
        return f"ascii(substring(acc.n, {of} + 1, 1))"

    added = f"if(x.inn < 0, acc.n, overlay(acc.n PLACING char({count('x.inn')} + 1) FROM x.inn + 1 FOR 1))"
    scan = f"""
      aggregate({steps},
        named_struct('n', repeat(' ', 128), 's', 0L, 'from', -1, 'to', -1, 'spans', cast(array() as array<struct<start:int,end:int>>)),
        (acc, x) -> named_struct(
          'n', if(x.inn = x.out, acc.n, if(x.out < 0, {added}, overlay({added} PLACING char({count('x.out')} - 1) FROM x.out + 1 FOR 1))),
          's', acc.s + if(x.inn = x.out or x.inn < 0, 0L, {more}[{count('x.inn')} - 32])
                     - if(x.inn = x.out or x.out < 0, 0L, {more}[{count('x.out')} - 33]),
          'from', if(x.i >= {window} and acc.s <= {most} and (acc.from < 0 or acc.to < x.i - {window}), x.i - {window}, acc.from),
          'to', if(x.i >= {window} and acc.s <= {most}, x.i, acc.to),
          'spans', if(x.i >= {window} and acc.s <= {most} and acc.from >= 0 and acc.to < x.i - {window},
                      array_append(acc.spans, named_struct('start', acc.from, 'end', acc.to)), acc.spans)),
        acc -> if(acc.from >= 0, array_append(acc.spans, named_struct('start', acc.from, 'end', acc.to)), acc.spans))"""
    return f"""
      flatten(transform(array(transform(split(c.val, ''), ch -> ascii(ch))), codes ->
        transform({scan}, s -> named_struct('start', c.start + s.start, 'end', c.start + s.end))))"""


def scan_secrets(df: DataFrame, window: int = WINDOW, classes: dict = CLASSES, allowed: list = ALLOWED,
                 id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, text, what is to be carried, and ``found``, an array of (kind, start, end) by start, then base kinds before classes."""
    rows = common.id_text(df, id_col, text_col, carry)
    rows = _located(rows, "assign", ASSIGN, 2, 8)
    rows = _located(rows, "access", ACCESS)
    rows = _located(rows, "hex", HEX)
    for name, (chars, threshold) in classes.items():
        rows = _located(rows, name, f"[{chars}]{{{window},}}")
        whole, inner = [p for p in allowed if p.startswith("^")], [p for p in allowed if not p.startswith("^")]
        candidates = f"transform({name}, c -> named_struct('start', c.start, 'end', c.end, 'val', c.val, 'cut', false))"
        for p in inner:
            candidates = f"flatten(transform({candidates}, c -> {_without(p, window)}))"
        suppressed = " or ".join(f"c.val rlike {_sql(p)} or (c.cut and btrim(c.val, '/=+_-') rlike {_sql(p)})" for p in whole) or "false"
        candidates = f"filter({candidates}, c -> not ({suppressed}))"
        rows = rows.withColumn(name, F.expr(f"flatten(transform({candidates}, c -> {_high_entropy(window, threshold)}))"))
    kinds = ["assign", "access", "hex", *classes]
    numbered = ", ".join(
        f"transform({name}, s -> named_struct('start', s.start, 'rank', {i}, 'end', s.end, 'kind', '{name}'))" for i, name in enumerate(kinds)
    )
    return rows.select("doc_id", "text", *(["carried"] if carry else []), F.expr(f"array_sort(concat({numbered}))").alias("found"))


def redacted(found: str = "found", text: str = "text", mark: str = "[SECRET]") -> Column:
    """The text with every run of overlapping spans replaced by ``mark``; spans are in order of their starts.

    What stays in front of a run begins where all spans before it have ended.  Such pieces are cut from the text
    block by block, so that a cut never counts characters from the beginning of a long text.
    """
    reach = _before("ends", 0, lambda a, b: f"greatest({a}, {b})")
    cuts = f"""
      filter(zip_with({found}, {reach}, (s, r) -> named_struct('from', r, 'to', s.start)), d -> d.to >= d.from)"""
    block = f"""
      transform(array(named_struct('some', slice(cuts, cast(k * {BLOCK} + 1 as int), {BLOCK}))), b ->
        transform(array(substring({text}, b.some[0].from + 1, element_at(b.some, -1).to - b.some[0].from)), part ->
          array_join(transform(b.some, d -> concat(substring(part, d.from - b.some[0].from + 1, d.to - d.from), '{mark}')), ''))[0])[0]"""
    return F.expr(f"""
      if(size({found}) = 0, {text},
        concat(
          transform(array(transform({found}, s -> s.end)), ends ->
            transform(array({cuts}), cuts ->
              array_join(transform(sequence(0, cast((size(cuts) - 1) div {BLOCK} as int)), k -> {block}), ''))[0])[0],
          substring({text}, array_max(transform({found}, s -> s.end)) + 1)))""")


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = scan_secrets(common.table(spark, sf_dir, "documents")).drop("text")
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = _listed("filter(found, s -> s.kind in ('assign', 'access', 'hex'))")
    return found.select("doc_id", *counts, F.sha2(F.expr(base), 256).alias("base_sha256"), F.expr(_listed("found")).alias("spans"))
