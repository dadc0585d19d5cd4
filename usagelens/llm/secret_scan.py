"""Secret scans with built-in expressions only.

Three patterns give the base spans. Beside them, every candidate string (a long run of the
characters that keys are made of) is swept by a window: the Shannon entropy of each window
follows from counts that change by the character that enters and the one that leaves. Windows
above the limit of the candidate's character class are joined into spans of kind ``entropy``;
base spans and what the allow-list names are cut out of a candidate first, and every part of 20
or more characters that is left is swept.

Spans are in code points, the end exclusive. Positions come from marking the matches in a copy
of the text in which the marks' own characters were replaced by another one outside all patterns.

Entropies are sums of whole numbers (c log2 c in millionths), so every engine gets the same.

Texts are scanned whole, whatever their length: the work is linear in the length of a text and
of a candidate and in the number of matches, but for the base spans inside one candidate, which
grow an array.

Defined cases: a null text is empty and has no spans; repeated rows are scanned each; a null
``doc_id`` is kept; empty tables give empty results; other columns pass through ``redact``
whatever their names; spans that start together come by kind, as listed in ``KINDS``, then end.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]
# The base patterns.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
    r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Candidates: runs of these characters of 20 or more that have both digits and letters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
# Least entropy of a window, in bits a character, by the class of the whole candidate.
LIMITS = {"hex": 3.0, "upper": 3.5, "mixed": 3.7}
# Candidates that match any of these have parts that are no secrets: identifiers with hyphens,
# version or file paths, placeholders. Those parts are cut out, the rest is swept.
ALLOW = [
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|xxxx",
    r"^[a-z]+([-_/][a-z0-9]+)+$",
    r"0123456789|abcdefghij",
]
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: What is cut out of a candidate on the list: placeholders, with the separators beside them.
_PLACEHOLDERS = (
    f"[-_/]*(?:(?i:example|placeholder|changeme|x{{4,}})|0123456789|abcdefghij|"
    f"(?<![A-Za-z0-9]){_UUID}(?![A-Za-z0-9]))[-_/]*"
)
#: A rest in lower case loses its dictionary-like parts too: letters, digits, or letters with up to
#: three digits behind them if the part is too short for a window.
_LOWER = "^[-_/a-z0-9]+$"
_WORDS = (
    f"(?<![a-z0-9])[-_/]*(?:[a-z]+|[0-9]+|(?=[a-z0-9]{{1,{WINDOW - 1}}}(?![a-z0-9]))[a-z]+[0-9]{{1,3}})(?![a-z0-9])[-_/]*"
)
_PIECES = "array<struct<start:long,text:string,cut:boolean>>"
# Marks of matches, and what takes their place in the text; none is in a pattern.
_OPEN, _SHUT, _OTHER = "\u0001", "\u0002", "\u0003"
_MILLION = 1_000_000
#: Windows of a block, values of a block of running sums; characters of a chunk of text.
_BLOCK, _CHUNK = 64, 256
_SPANS = "array<struct<start:long,kind:int,end:long>>"
#: Where a text is cut: at what no pattern holds, and at spaces without : or = beside them.
_SEGMENT = r"""(?:[A-Za-z0-9+/_.=:'"-]|(?<=[:=])\x20++|\x20++(?=[:=])|(?<=["'])\x20++(?=[:=]))++"""
#: c log2 c in millionths, for a count of 0 to WINDOW.
C_LOG_C = [0, *(round(c * math.log2(c) * _MILLION) for c in range(1, WINDOW + 1))]


def entropy_total(limit: float) -> int:
    """The largest sum of c log2 c with which a window still has this entropy."""
    return math.floor(WINDOW * (math.log2(WINDOW) - limit) * _MILLION)


def _plain(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _OPEN + _SHUT, _OTHER * 2)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used in there."""
    return F.transform(F.array(value), then)[0]


def _scan(values: Column, first: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join`` makes of all values before each: running sums, for example.

    An array grows by copies; so running values are made in blocks, and the blocks' starts before.
    """

    def grown(v: Column, start: Column) -> Column:
        return F.aggregate(v, F.array(start), lambda acc, x: F.concat(acc, F.array(join(F.element_at(acc, -1), x))))

    def blocks(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / _BLOCK).cast("int") - 1, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * _BLOCK + 1, _BLOCK))
        return _let(parts, whole)

    def whole(parts: Column) -> Column:
        starts = grown(F.transform(parts, lambda part: F.aggregate(part, first, join)), first)
        inner = F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda part, start: grown(part, start))
        return F.flatten(F.transform(inner, lambda x: F.slice(x, 1, F.size(x) - 1)))

    return _let(values, blocks)


def _lengths(texts: Column, less: int = 0) -> Column:
    return F.transform(texts, lambda t: (F.char_length(t) - less).cast("long"))


def _sums(values: Column) -> Column:
    return _scan(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _matches(plain: Column, pattern: str) -> Column:
    """array<struct<start, text>> of all leftmost non-overlapping matches."""
    marked = F.regexp_replace(plain, pattern, f"{_OPEN}$0{_SHUT}")

    def found(parts: Column) -> Column:
        # every part but the first is a match, its end mark, and the text up to the next match;
        # the first gets a mark, too
        starts = _sums(_lengths(parts, 1))
        texts = F.transform(parts, lambda t: F.substring_index(t, _SHUT, 1))
        return F.slice(
            F.zip_with(starts, texts, lambda s, t: F.struct((s + 1).alias("start"), t.alias("text"))),
            2,
            F.greatest(F.size(parts) - 1, F.lit(1)),
        )

    none = F.array().cast("array<struct<start:long,text:string>>")
    return F.when(F.regexp_like(plain, F.lit(pattern)), _let(F.split(marked, _OPEN, -1), found)).otherwise(none)


def _spans(found: Column, kind: int) -> Column:
    """The matches as array<struct<start, kind, end>>."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.lit(kind).alias("kind"),
            (m["start"] + F.char_length(m["text"])).alias("end"),
        ),
    )


def base_spans(plain: Column) -> Column:
    """array<struct<start, kind, end>> of the three patterns, in order."""
    # A whole match read again by itself gives the same groups: it starts at the keyword, and
    # the value's run ends with it.
    assign = F.filter(
        _matches(plain, ASSIGN),
        lambda m: F.char_length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_LEAST,
    )
    # A run that fails has no longer run inside, so the least length can stand in the pattern.
    access = _matches(plain, f"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
    hexed = _matches(plain, f"[0-9a-f]{{{HEX_LEAST},}}")
    return F.array_sort(F.concat(_spans(assign, 0), _spans(access, 1), _spans(hexed, 2)))


def _limit(candidate: Column) -> Column:
    """The largest sum of c log2 c for a window of this candidate to count, by its class."""
    return (
        F.when(F.regexp_like(candidate, F.lit("^[0-9a-f]+$")), F.lit(entropy_total(LIMITS["hex"])))
        .when(F.regexp_like(candidate, F.lit("^[0-9A-Z]+$")), F.lit(entropy_total(LIMITS["upper"])))
        .otherwise(F.lit(entropy_total(LIMITS["mixed"])))
    )


def _high(block: Column, limit: Column) -> Column:
    """Where in a block the windows begin whose sum of c log2 c is within the limit.

    From window to window two counts change: that of the character that leaves and that of the
    one that enters. Both are counted among the characters that stay.
    """
    table = F.array(*[F.lit(v) for v in C_LOG_C])
    stay = WINDOW - 1

    def weight(count: Column) -> Column:
        return F.element_at(table, count + 1)

    def gain(character: Column, among: Column) -> Column:
        count = F.lit(stay) - F.char_length(F.replace(among, character, F.lit("")))
        return _let(count, lambda c: weight(c + 1) - weight(c))

    def begin(first: Column) -> Column:
        return F.aggregate(
            F.array_distinct(F.split(first, "")),
            F.lit(0),
            lambda acc, c: acc + weight(F.lit(WINDOW) - F.char_length(F.replace(first, c, F.lit("")))),
        )

    def state(total: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.struct(total.alias("total"), F.when(total <= limit, F.array(F.lit(0))).otherwise(none).alias("found"))

    def step(acc: Column, at: Column) -> Column:
        both = F.substring(block, at, F.lit(WINDOW + 1))

        def moved(u: Column) -> Column:
            middle = F.substring(u, 2, stay)
            total = acc["total"] - gain(F.substring(u, 1, 1), middle) + gain(F.substring(u, WINDOW + 1, 1), middle)
            return _let(
                total,
                lambda t: F.struct(
                    t.alias("total"),
                    F.when(t <= limit, F.concat(acc["found"], F.array(at))).otherwise(acc["found"]).alias("found"),
                ),
            )

        return _let(both, moved)

    steps = F.char_length(block) - WINDOW
    later = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    start = _let(begin(F.substring(block, 1, WINDOW)), state)
    return _let(start, lambda s: F.aggregate(later, s, step, lambda acc: acc["found"]))


def _swept(text: Column, start: Column) -> Column:
    """array<struct<start, kind, end>>: windows within the limit; those that touch are one span."""
    # blocks that share all characters but one of a window
    blocks = F.regexp_extract_all(text, F.lit(f"(?=(.{{{WINDOW},{WINDOW + _BLOCK - 1}}})).{{1,{_BLOCK}}}"), F.lit(1))

    def found(limit: Column) -> Column:
        at = F.transform(blocks, lambda b, k: F.transform(_high(b, limit), lambda i: start + k * _BLOCK + i))
        return _let(F.flatten(at), _joined)

    return _let(_limit(text), found)


def _joined(begins: Column) -> Column:
    """The windows that begin there, as spans; those that touch or overlap are one."""
    first = F.filter(begins, lambda b, i: (i == 0) | (F.get(begins, i - 1) + WINDOW < b))
    last = F.filter(begins, lambda b, i: (i == F.size(begins) - 1) | (F.get(begins, i + 1) > b + WINDOW))
    return F.zip_with(
        first,
        last,
        lambda s, e: F.struct(s.cast("long").alias("start"), F.lit(3).alias("kind"), (e + WINDOW).cast("long").alias("end")),
    )


def _eligible(text: Column) -> Column:
    """Long enough for a window, with digits and letters."""
    return (
        (F.char_length(text) >= WINDOW)
        & F.regexp_like(text, F.lit("[0-9]"))
        & F.regexp_like(text, F.lit("[A-Za-z]"))
    )


def _uncovered(m: Column, base: Column) -> Column:
    """array<struct<start, text, cut>>: what base spans leave of a candidate."""
    end = m["start"] + F.char_length(m["text"])
    over = F.filter(base, lambda b: (b["start"] < end) & (b["end"] > m["start"]))
    state = F.struct(m["start"].alias("at"), F.array().cast(_PIECES).alias("found"))

    def piece(start: Column, stop: Column) -> Column:
        text = F.substring(m["text"], (start - m["start"] + 1).cast("int"), F.greatest(stop - start, F.lit(0)).cast("int"))
        return F.array(F.struct(start.alias("start"), text.alias("text"), F.lit(True).alias("cut")))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(
            F.greatest(acc["at"], b["end"]).alias("at"),
            F.concat(acc["found"], piece(acc["at"], b["start"])).alias("found"),
        )

    whole = F.array(F.struct(m["start"].alias("start"), m["text"].alias("text"), F.lit(False).alias("cut")))
    left = F.aggregate(over, state, step, lambda a: F.concat(a["found"], piece(a["at"], end)))
    return F.when(F.size(over) == 0, whole).otherwise(left)


def _outside(p: Column, pattern: str) -> Column:
    """array<struct<start, text, cut>>: what the matches of a pattern leave of a piece."""
    marked = F.split(F.regexp_replace(p["text"], pattern, f"{_OPEN}$0{_SHUT}"), f"[{_OPEN}{_SHUT}]", -1)

    def left(parts: Column) -> Column:
        pieces = F.zip_with(
            _sums(_lengths(parts)),
            parts,
            lambda s, t: F.struct((p["start"] + s).alias("start"), t.alias("text"), F.lit(True).alias("cut")),
        )
        return F.filter(pieces, lambda _, i: i % 2 == 0)  # every second one is a match

    return _let(marked, left)


def _kept(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: _eligible(p["text"]))


def _listed(p: Column) -> Column:
    """Whether the allow-list has something to cut out of a piece."""
    listed = p["cut"] & F.regexp_like(p["text"], F.lit(_LOWER))
    for pattern in ALLOW:
        listed = listed | F.regexp_like(p["text"], F.lit(pattern))
    return listed


def _without_placeholders(p: Column) -> Column:
    """array<struct<start, text, cut>>: a piece, whole if the list has nothing of it (then not cut)."""
    whole = F.struct(p["start"].alias("start"), p["text"].alias("text"), F.lit(False).alias("cut"))
    return F.when(_listed(p), _kept(_outside(p, _PLACEHOLDERS))).otherwise(F.array(whole))


def _without_words(p: Column) -> Column:
    """array<struct<start, text, cut>>: what dictionary-like parts leave of a listed piece in lower case."""
    lower = p["cut"] & F.regexp_like(p["text"], F.lit(_LOWER))
    return F.when(lower, _kept(_outside(p, _WORDS))).otherwise(F.array(p))


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"))
    )


def _moved(pieces: Column, by: Column) -> Column:
    return F.transform(
        pieces, lambda p: F.struct((p["start"] + by).alias("start"), p["text"].alias("text"), p["cut"].alias("cut"))
    )


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _looked_at(text: Column) -> Column:
    """Whether there is a candidate or a keyword; the other patterns' matches are candidates."""
    return F.regexp_like(text, F.lit(CANDIDATE)) | F.regexp_like(text, F.lit(ASSIGN))


def _scanned(docs: DataFrame, kept: list[Column]) -> DataFrame:
    """The kept columns, ``__base``, ``__more`` and ``__spans`` of every row.

    A text is worked on in segments that no pattern crosses. Most of them, and most texts, hold
    neither a candidate nor a keyword, and one look tells. Arrays of one step are named more than
    once in the next, or go through ``_let``, so no plan makes them again for every element.
    """
    plain, none = F.col("__plain"), F.array().cast("array<struct<start:long,text:string>>")
    segments = F.filter(_matches(plain, _SEGMENT), lambda m: _looked_at(m["text"]))
    step = docs.select(*kept, _plain(F.col("text")).alias("__plain"))
    step = step.withColumn("__segments", F.when(_looked_at(plain), segments).otherwise(none)).drop("__plain")
    step = step.withColumn("__bases", F.transform("__segments", lambda m: base_spans(m["text"])))

    def rests(m: Column, base: Column) -> Column:
        found = F.filter(_matches(m["text"], CANDIDATE), lambda c: _eligible(c["text"]))
        return _moved(_kept(F.flatten(F.transform(found, lambda c: _uncovered(c, base)))), m["start"])

    step = step.withColumns(
        {
            "__base": F.flatten(F.zip_with("__segments", "__bases", lambda m, b: _shifted(b, m["start"]))),
            "__pieces": F.flatten(F.zip_with("__segments", "__bases", rests)),
        }
    ).drop("__segments", "__bases")
    for cut in (_without_placeholders, _without_words):
        step = step.withColumn("__pieces", F.flatten(F.transform("__pieces", cut)))
    more = F.flatten(F.transform("__pieces", lambda p: _swept(p["text"], p["start"])))
    step = step.withColumn("__more", more).drop("__pieces")
    return step.withColumn("__spans", F.array_sort(F.concat("__base", "__more")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy), one row per document."""
    base = F.col("__base")
    return _scanned(docs, [F.col("doc_id").cast("long").alias("doc_id")]).select(
        "doc_id",
        _count(base, 0).alias("n_assign"),
        _count(base, 1).alias("n_access"),
        _count(base, 2).alias("n_hex"),
        F.sha2(_named(base), 256).alias("base_sha256"),
        _named(F.col("__spans")).alias("spans"),
        F.size("__more").cast("long").alias("n_entropy"),
    )


def redact(docs: DataFrame, placeholder: str = "[secret]") -> DataFrame:
    """The documents with every span (overlapping ones as one) replaced; all columns kept.

    ``n_chars``, if there is such a column, is set anew where the text changed. Texts without
    spans pass unchanged.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{n}`") for n in names]).alias("__row")
    text = F.col("__row.text")

    def cleaned(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: x["end"])
        # a span that begins inside an earlier one is part of it
        reached = _scan(ends, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x))
        between = F.filter(
            F.zip_with(
                F.concat(reached, F.array(F.array_max(ends))),
                F.concat(F.transform(spans, lambda x: x["start"]), F.array(F.char_length(text).cast("long"))),
                lambda at, stop: F.struct(at.alias("at"), stop.alias("stop")),
            ),
            lambda x: x["at"] <= x["stop"],
        )
        return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), lambda chunks: _texts(chunks, between))

    def _texts(chunks: Column, between: Column) -> Column:
        def piece(x: Column) -> Column:
            first, last = F.floor(x["at"] / _CHUNK), F.floor(F.greatest(x["stop"] - 1, x["at"]) / _CHUNK)
            near = F.array_join(F.slice(chunks, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
            return F.substring(near, (x["at"] % _CHUNK + 1).cast("int"), (x["stop"] - x["at"]).cast("int"))

        return F.array_join(F.transform(between, piece), placeholder)

    found = F.size("__spans") > 0
    scanned = _scanned(docs.select("*"), [row, F.col("text").alias("text")])
    new = _let(F.col("__spans"), cleaned)
    scanned = scanned.select("__row", found.alias("__found"), F.when(found, new).otherwise(text).alias("__text"))
    columns = []
    for n in names:
        old = F.col("__row")[n]
        if n == "text":
            old = F.col("__text")
        elif n == "n_chars":
            old = F.when(F.col("__found"), F.char_length("__text").cast(docs.schema[n].dataType)).otherwise(old)
        columns.append(old.alias(n))
    return scanned.select(*columns)
