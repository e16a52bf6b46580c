"""One consistent form for texts that look the same (problem 9)."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlight.session import spread, written

# Letters of other scripts that are drawn like a Latin letter, and that letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "Ӏ": "I", "Ԁ": "d",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ԛ": "q", "ԝ": "w", "һ": "h", "ԁ": "d", "ӏ": "l", "ѵ": "v", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "ո": "n", "հ": "h",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R",
    "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N",
    "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ℓ": "l", "∨": "v", "∣": "|", "∶": ":", "∕": "/", "−": "-", "‐": "-", "‑": "-", "﹣": "-", "’": "'", "‘": "'", "ʼ": "'", "′": "'",
}
#: Compatibility decompositions that don't change how a text looks.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<font>")
#: Code points with a <compat> decomposition that looks the same: ligatures, the ellipsis, the micro sign, Roman numerals.
SAME_COMPAT = (range(0xFB00, 0xFB18), range(0x2026, 0x2027), range(0xB5, 0xB6), range(0x2160, 0x2180))
#: Small capitals look like a small letter where that has the shape of its capital, else like the capital.
SMALL_LIKE_CAPITAL = "cosvwxz"
DROPPED = -1
#: Characters that may change; texts without any are fixed points.
ODD = r"[^\t\n\x20-\x7E]"


#: Planes that hold assigned characters other than private ones.
PLANES = (range(0x0, 0xD800), range(0xE000, 0x33480), range(0xE0000, 0xE0200))


@lru_cache(1)
def mapping_rows() -> tuple[list[tuple[int, tuple[int, ...], int]], list[tuple[int, int, int]]]:
    """The mapping tables: (code point, its parts, combining class) where either isn't trivial, and (base, mark, composed).

    Built by rule from the Unicode character database and the look-alikes, so their size is bounded by Unicode.
    """
    rows = []

    @lru_cache(None)
    def full(ch: str) -> str:
        d = unicodedata.decomposition(ch)
        kind = d.split(" ")[0] if d.startswith("<") else ""
        cp = ord(ch)
        same = not kind or kind in SAME_LOOK or kind == "<compat>" and any(cp in r for r in SAME_COMPAT)
        if ch in LOOK_ALIKES:
            return LOOK_ALIKES[ch]
        if not d or not same:
            name = unicodedata.name(ch, "")
            letter = name[-1:].lower() if name.startswith("LATIN LETTER SMALL CAPITAL ") and name[-2] == " " else ""
            return (letter if letter in SMALL_LIKE_CAPITAL else letter.upper()) or ch
        return "".join(full(chr(int(x, 16))) for x in d.split(" ")[bool(kind) :])

    composed = []
    for cp in (x for plane in PLANES for x in plane):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category in ("Cn", "Co") or 0xAC00 <= cp <= 0xD7A3:
            continue  # composed Hangul is what recomposition would give again
        if category == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
            parts: tuple[int, ...] = ()
        elif category == "Cc" and cp not in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85):
            parts = ()  # other control characters aren't drawn
        elif category == "Zs":
            parts = (0x20,)
        elif category in ("Zl", "Zp") or cp in (0x85, 0x0B, 0x0C):
            parts = (0x0A,)
        else:
            parts = tuple(map(ord, full(ch)))
        if parts != (cp,) or unicodedata.combining(ch):
            rows.append((cp, parts, unicodedata.combining(ch)))
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", ch) == ch:
            a, b = (int(x, 16) for x in d.split(" "))
            if LOOK_ALIKES.get(chr(a), chr(a)) == chr(a):
                composed.append((a, b, cp))
    return rows, composed


class Mapping:
    """The mapping tables as arrays for lookups by code point."""

    def __init__(self, rows: list[tuple[int, tuple[int, ...], int]], composed: list[tuple[int, int, int]]):
        self.first = np.arange(0x110000, dtype=np.int32)
        self.more = np.zeros(0x110000, dtype=np.int8)
        self.order = np.zeros(0x110000, dtype=np.uint8)
        self.tails = {}
        for cp, parts, cls in rows:
            self.order[cp] = cls
            self.first[cp] = parts[0] if parts else DROPPED
            if len(parts) > 1:
                self.more[cp] = len(parts) - 1
                self.tails[cp] = parts[1:]
        self.pairs = {a << 21 | b: cp for a, b, cp in composed}


@lru_cache(2)
def _mapping(broadcast: object = None) -> Mapping:
    return Mapping(*(broadcast.value if broadcast else mapping_rows()))


def one_form(texts: list[str], mapping: Mapping | None = None) -> list[str]:
    """The consistent form of each text.

    All texts are laid out as one table of (text, position, code point). A lookup in the mapping
    tables gives each code point's parts; dropped ones leave; runs of combining marks are put into
    the order of their classes; a mark is composed with its base where Unicode has the pair and no
    mark of its class or a higher one stands between. CR LF and CR become LF.
    """
    m = mapping or _mapping()
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int32)
    ends = np.cumsum([len(t) for t in texts])
    odd = np.flatnonzero((points >= 0x7F) | (points < 0x20) & (points != 0x09) & (points != 0x0A))
    if not len(odd):
        return texts
    head = points.copy()
    head[odd] = m.first[points[odd]]
    longer = odd[m.more[points[odd]] > 0]
    step = np.ones(len(points), dtype=np.int32)
    if len(longer):
        tails = [m.tails[cp] for cp in points[longer].tolist()]
        step[longer] += np.fromiter(map(len, tails), dtype=np.int32, count=len(tails))
        at = np.repeat(longer + 1, [len(t) for t in tails])
        head = np.insert(head, at, [x for t in tails for x in t])
        ends = np.concatenate([[0], np.cumsum(step)])[ends]
    keep = head != DROPPED
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    head = head[keep]
    marks = np.flatnonzero(m.order[head])
    if len(marks):
        gone, begins = np.zeros(len(head), dtype=bool), set(ends.tolist())
        for group in np.split(marks, np.flatnonzero(np.diff(marks) > 1) + 1):
            a, b = int(group[0]), int(group[-1]) + 1
            cuts = [a, *[x for x in range(a + 1, b) if x in begins], b]  # a run never leaves its text
            for x, y in zip(cuts, cuts[1:]):
                run = head[x:y]
                run = run[np.argsort(m.order[run], kind="stable")]
                head[x:y] = run
                base = x - 1
                if base < 0 or x in begins or m.order[head[base]]:
                    continue
                last = 0
                for i, cp in enumerate(run.tolist(), x):
                    c = int(m.order[cp])
                    made = m.pairs.get(int(head[base]) << 21 | cp)
                    if made is not None and c > last:
                        head[base], gone[i] = made, True
                    else:
                        last = max(last, c)
        ends = np.concatenate([[0], np.cumsum(~gone)])[ends]
        head = head[~gone]
    whole = head.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


def consistent(column: str | Column) -> Column:
    """Column of texts in their consistent form; null stays null. Texts of printable ASCII, tabs and line feeds are fixed points and stay in the JVM."""

    tables = SparkSession.getActiveSession().sparkContext.broadcast(mapping_rows())  # a few thousand rows, bounded by Unicode

    @F.pandas_udf("string")
    def formed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            known = batch.notna()
            out = batch.copy()
            if known.any():
                out[known] = one_form(batch[known].tolist(), _mapping(tables))
            yield out

    c = F.col(column) if isinstance(column, str) else column
    odd = c.rlike(ODD)
    return F.when(odd, formed(F.when(odd, c))).otherwise(c)


def canonical_texts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, canonical, changed) for every row."""
    formed = df.select(F.col(id_column), F.col(text_column).alias("_t"), consistent(text_column).alias("canonical"))
    return formed.select(id_column, "canonical", (F.col("canonical") != F.col("_t")).alias("changed"))


@lru_cache(1)
def still_class() -> str:
    """Regex class of characters that keep their form wherever no mark follows: printable ASCII, tabs, line feeds, and by rule from the mapping those of U+00A1 to U+00FF (a small class is searched fast)."""
    own = [cp for cp in range(0xA1, 0x100) if unicodedata.category(chr(cp)) != "Cn" and not unicodedata.combining(chr(cp)) and one_form([chr(cp)]) == [chr(cp)]]
    ranges: list[list[int]] = []
    for cp in own:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"\t\n\x20-\x7E" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in ranges)


def mapping_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, Column]:
    """The mapping, bounded by Unicode: tables (ch, parts) of characters that change and (ch, class) of combining marks, and a constant map from (base, mark) to their composition."""
    rows, composed = mapping_rows()
    text = lambda cps: "".join(map(chr, cps))
    parts = [(chr(cp), [chr(x) for x in p]) for cp, p, _ in rows if p != (cp,)]
    classes = [(chr(cp), cls) for cp, _, cls in rows if cls]
    made = json.dumps({text((a, b)): chr(c) for a, b, c in composed})
    # Constants of the plan: made in the JVM, without a job for rows from Python.
    constant = lambda rows, names, fields: spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rows])), f"array<struct<{fields}>>")).alias("x")).select("x.*")
    return constant(parts, ("ch", "parts"), "ch: string, parts: array<string>"), constant(classes, ("ch", "class"), "ch: string, class: int"), F.from_json(F.lit(made), "map<string, string>")


def digest(c: Column) -> Column:
    return F.unhex(F.md5(c.cast("binary")))


def forms_by_joins(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, variant, canonical) of the rows with a text: variant is the 128-bit hash of the text, canonical the same form as of consistent, step by step on tables.

    Texts are exploded to positioned characters, joined with the broadcast mapping tables (bounded by Unicode), marks are ordered by class behind their base,
    composed with it, and the strings rebuilt. Runs of characters that can't change stay together as one piece, and texts of such characters alone aren't
    exploded at all. Rows with the same id are told apart by their texts; repeated rows give one row or several equal ones.
    """
    parts, classes, pairs = mapping_tables(df.sparkSession)
    known = df.filter(F.col(text_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("t"))
    still = still_class()
    odd = F.col("t").rlike(ODD) & F.col("t").rlike(f"[^{still}]")  # the first is the cheaper one
    plain = known.filter(~odd).select("id", digest(F.col("t")).alias("variant"), F.col("t").alias("canonical"))
    texts = known.filter(odd).select("id", digest(F.col("t")).alias("variant"), F.regexp_replace("t", "\r\n?", "\n").alias("t")).dropDuplicates(["id", "variant"])
    # Runs of unchanging characters but for their last one, which a mark may follow; then single characters. An empty piece goes first, so no text is lost.
    piece = f"[{still}]+(?=[{still}])|(?s:.)"
    pieces = F.concat(F.array(F.lit("")), F.regexp_extract_all("t", F.lit(f"({piece})"), 1))
    points = texts.select("id", "variant", F.posexplode(pieces).alias("at", "ch"))
    mapped = points.join(F.broadcast(parts), "ch", "left").withColumn("parts", F.coalesce("parts", F.array("ch")))
    single = mapped.select("id", "variant", "at", F.posexplode("parts").alias("inner", "ch")).join(F.broadcast(classes), "ch", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    place = Window.partitionBy("id", "variant").orderBy("at", "inner")  # one text at a time
    based = single.withColumn("base", F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(place))
    # Most runs are one piece; a mark composes with its base by a constant map, which is only looked into for marks.
    marked = based.groupBy("id", "variant", "base").agg(F.sort_array(F.collect_list(F.struct("class", "at", "inner", "ch"))).alias("run"))

    def compose(held: Column, mark: Column) -> Column:
        """A mark composes with the base where Unicode has the pair and no mark of its class or a higher one was left in between."""
        whole = F.try_element_at(pairs, F.concat(held["base"], mark["ch"]))
        fits = whole.isNotNull() & (mark["class"] > held["last"])
        return F.when(fits, F.struct(whole.alias("base"), held["rest"].alias("rest"), held["last"].alias("last"))).otherwise(
            F.struct(held["base"].alias("base"), F.concat(held["rest"], mark["ch"]).alias("rest"), F.greatest(held["last"], mark["class"]).alias("last"))
        )

    start = F.struct(F.col("run")[0]["ch"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    joined = F.aggregate(F.slice("run", 2, F.size("run")), start, compose, lambda x: F.concat(x["base"], x["rest"]))
    formed = marked.select("id", "variant", "base", F.when(F.size("run") == 1, F.col("run")[0]["ch"]).otherwise(joined).alias("text"))
    rebuilt = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", "text"))), lambda x: x["text"]), "")
    return plain.unionByName(formed.groupBy("id", "variant").agg(rebuilt.alias("canonical")))


def canonical_by_joins(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, canonical) of the rows with a text, by forms_by_joins."""
    return forms_by_joins(df, id_column, text_column).select(F.col("id").alias(id_column), "canonical")


def same_look_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b): ids whose whole texts look the same but aren't equal, the smaller first.

    Forms come from forms_by_joins. Then only ids and 128-bit hashes of the text and of its form are shuffled. Equal texts count as one
    variant: a look with one variant has no pairs and leaves before the join. Null texts are left out.
    """
    texts = spread(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("t")))
    keys = written(forms_by_joins(texts, "id", "t").select("id", digest(F.col("canonical")).alias("look"), "variant"))
    varied = keys.groupBy("look").agg(F.min("variant").alias("lo"), F.max("variant").alias("hi")).filter("lo <> hi").select("look")
    members = written(keys.join(varied, "look"))
    # Variants meet once, then their members are listed: a text repeated many times is one row here.
    variants = members.select("look", "variant").distinct()
    pairs = variants.withColumnRenamed("variant", "va").join(variants.withColumnRenamed("variant", "vb"), "look").filter("va < vb").drop("look")
    pairs = pairs.join(members.select(F.col("variant").alias("va"), F.col("id").alias("a")), "va").join(members.select(F.col("variant").alias("vb"), F.col("id").alias("b")), "vb")
    return pairs.filter("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
