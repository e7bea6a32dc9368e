"""Several values packed in one field: dictionary-guided segmentation.

A cell such as ``a; "b; c"; d`` holds a list. Marks that always separate (semicolons, bars,
bullets, tabs, line ends, spaced slashes) and marks that may belong to a value (commas, joining
words) cut the cell into pieces. Two passes over the data:

1. dictionary: values whose limits are certain (quoted, or between strong marks) and which hold
   a mark inside, with the number of cells that show them;
2. segmentation: an Aho-Corasick automaton over that dictionary marks every known whole value in
   a cell, and dynamic programming picks the cheapest cover of the pieces, so that a comma inside
   ``models, statistical`` stays while the comma of a comma list cuts.

Personal names have a dictionary of their own (whole names that stand between strong marks or in
quotes), which decides where a comma cell could be read in two ways; where it says nothing, the form of
names does (two words at least, initials never alone).

The dictionary is sent to the executors in blocks of bounded size, one after the other, so that the
driver holds one of them; a larger dictionary only means more blocks, each a narrow pass that adds its
matches to the cell. Values have no greatest length and no greatest number of commas.

Defined results: a null, empty or blank cell gives no rows; an empty table gives an empty table;
repeated values keep their places; very long cells are cut whole (cost grows linearly);
other columns of the input are ignored and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, spread

#: Marks that always separate; a semicolon that ends a character reference doesn't.
_STRONG = re.compile(r"[;；|•、\t\r\n]+| / ")
_REFERENCE = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
_JOIN = re.compile(r"(?:,\s*)?\s(?:and|&|et|und|y)\s")
_LEAD = re.compile(r"^(?:and|&)\s+")
_MARKS = re.compile(r"[;；|•、,/\t\r\n]")
_INITIALS = re.compile(r"^(?:[^\W\d_]\.?[\s-]?){1,4}$")
#: Words that open a family name, and name suffixes.
_PARTICLES = frozenset("de la da di del dos du van von der den el al bin ter ten le".split())
_SUFFIXES = frozenset("jr jr. sr sr. ii iii iv".split())

#: A dictionary value is kept when at least so many cells show it.
MIN_SUPPORT = 2
#: Characters of the values of one broadcast block.
BLOCK_CHARS = 20_000_000


def _fold(s: str) -> str:
    return " ".join(s.lower().split())


def _is_quote_end(s: str, i: int) -> bool:
    rest = s[i:].lstrip(" ")
    return not rest or bool(re.match(r"[;；|•、,\t\r\n\]/]", rest)) or bool(_LEAD.match(rest))


def pieces(cell: str) -> tuple[str, list[tuple[str, bool, str, int, int]]]:
    """The cell without list brackets, and its pieces: (text, quoted, mark before it, start, end).
    mark: '' at the start, 's' strong, 'c' comma. Quotes around a piece are gone and doubled
    quotes are single."""
    s = cell.strip()
    if s.startswith("[") and s.endswith("]"):
        s = s[1:-1].strip()
    out: list[tuple[str, bool, str, int, int]] = []
    i, n, start, mark = 0, len(s), 0, ""

    def close(end: int) -> None:
        text = s[start:end].strip()
        if text:
            out.append((text, False, mark, start, end))

    while i < n:
        ch = s[i]
        if ch == '"' and not s[start:i].strip():
            j, ok = i + 1, -1
            while j < n:
                if s[j] == '"':
                    if j + 1 < n and s[j + 1] == '"':
                        j += 2
                        continue
                    if _is_quote_end(s, j + 1):
                        ok = j
                    break
                j += 1
            if ok >= 0:
                text = s[i + 1 : ok].replace('""', '"').strip()
                if text:
                    out.append((text, True, mark, i, ok + 1))
                start = i = ok + 1
                mark = mark if not text else "s"
                continue
        if ch == "&" and (m := _REFERENCE.match(s, i)):
            i = m.end()
            continue
        if m := _STRONG.match(s, i):
            close(i)
            start = i = m.end()
            mark = "s"
            continue
        if ch == ",":
            close(i)
            start = i = i + 1
            mark = "c"
            continue
        i += 1
    close(n)
    return s, out


def _strong_outside_quotes(cell: str) -> bool:
    return bool(_STRONG.search(_REFERENCE.sub("", re.sub(r'"(?:[^"]|"")*"', "", cell)).strip()))


def certain_values(cell: str | None) -> list[str]:
    """Folded values with a mark inside whose limits are certain."""
    if not cell or not _MARKS.search(cell):
        return []
    out = []
    if '"' in cell:
        out += [p[0] for p in pieces(cell)[1] if p[1] and _MARKS.search(p[0])]
    if _strong_outside_quotes(cell):
        body = re.sub(r'"(?:[^"]|"")*"', "\t", _REFERENCE.sub(lambda m: m[0].replace(";", "\0"), cell))
        out += [v for p in _STRONG.split(body) if _MARKS.search(v := p.replace("\0", ";").strip()) and '"' not in v and not v.startswith("[")]
    return [v for p in out if not (v := _fold(p)).startswith(",") and not v.endswith(",")]


def _name_cost(parts: list[tuple]) -> float:
    """Cost of reading the pieces as one person's name."""
    if len(parts) == 1:
        text, quoted = parts[0][:2]
        if quoted:
            return 0.0
        words = text.split()
        if _INITIALS.match(text) and len(text.replace(".", "").replace(" ", "").replace("-", "")) <= 4 and (len(words) > 1 or len(text.rstrip(".")) == 1 or "." in text):
            return 50.0
        if len(words) < 2:
            return 5.0
        given = [w for w in words if w.lower() not in _PARTICLES]
        return 0.2 if len(given) >= 2 else 5.0
    if any(p[1] for p in parts):
        return 60.0
    first, second = parts[0][0], parts[1][0]
    if len(parts) == 3:
        return 0.3 if second.lower() in _SUFFIXES or parts[2][0].lower() in _SUFFIXES else 60.0
    if len(parts) > 3:
        return 60.0
    words = first.split()
    if words[-1].rstrip(".").upper() == words[-1].rstrip(".") and len(words[-1].rstrip(".")) <= 2 and len(words) > 1:
        return 5.0  # the first piece already ends with its initials
    if len(words) == 1 or words[0].lower() in _PARTICLES or _INITIALS.match(second):
        return 0.1 if _INITIALS.match(second) else 0.3
    return 0.3 if len(second.split()) == 1 else 1.0


def _cover(cell: str, parts: list[tuple], known: set[str], names: bool, whole: bool) -> list[str]:
    """Cheapest cover of comma pieces by values. whole: strong marks exist, so commas belong to values."""
    n = len(parts)
    if n == 1:
        return [parts[0][0]]

    def text(i: int, j: int) -> str:
        return parts[i][0] if j - i == 1 else cell[parts[i][3] : parts[j - 1][4]].strip()

    if whole and not any(p[1] for p in parts):
        return [text(0, n)]
    best, back = [0.0] + [1e9] * n, [0] * (n + 1)
    most = max([3 if names else 1, *(k.count(",") + 1 for k in known)])  # no longer value can be cheapest
    for j in range(1, n + 1):
        for i in range(max(0, j - most), j):
            group = parts[i:j]
            if names:
                cost = _name_cost(group)
            elif j - i == 1:
                cost = 1.0
            else:
                cost = 1e6 if any(p[1] for p in group) else 4.0 * (j - i)
            if j - i > 1 and known and _fold(text(i, j)) in known:
                cost = min(cost, 0.05) if names else 0.5
            if best[i] + cost < best[j] - 1e-12:
                best[j], back[j] = best[i] + cost, i
    out, j = [], n
    while j:
        out.append(text(back[j], j))
        j = back[j]
    return out[::-1]


def segment(cell: str | None, known: Iterable[str] = (), names: bool = False) -> list[str]:
    """Values of a cell in order. known: folded dictionary values found in the cell."""
    if not cell or not cell.strip():
        return []
    s, parts = pieces(cell)
    strong = _strong_outside_quotes(cell)
    known = known if isinstance(known, set) else set(known)
    values: list[str] = []
    run: list[tuple] = []

    def flush() -> None:
        if run:
            values.extend(_cover(s, run, known, names, strong))
            run.clear()

    for part in parts:
        if run and part[2] != "c":
            # a quoted value ended by a comma starts a new run only where strong marks rule
            if strong or not (run[-1][1] and part[2] == "s"):
                flush()
        run.append(part)
    flush()
    out = []
    for k, v in enumerate(values):
        if k and (m := _LEAD.match(v)) and (not names or len(v[m.end() :].split()) > 1):
            v = v[m.end() :]
        if names and (m := _JOIN.search(v)) and len(v[: m.start()].strip(" ,").split()) > 1 and len(v[m.end() :].split()) > 1:
            left, right = v[: m.start()].strip(" ,"), v[m.end() :].strip()
            out += segment(left, known, True) + segment(right, known, True)
        elif v.strip():
            out.append(v.strip())
    return out


def _automaton(values: list[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for v in values:
        a.add_word(v, v)
    if values:
        a.make_automaton()
    return a


def known_in(automaton: ahocorasick.Automaton, cell: str | None) -> list[str]:
    """Dictionary values that stand in the cell as whole pieces."""
    if not cell or not len(automaton):
        return []
    s, out = _fold(cell), []
    for end, v in automaton.iter(s):
        a, b = end - len(v) + 1, end + 1
        before, after = s[:a].rstrip()[-1:], s[b:].lstrip()[:1]
        if (not before or before in ';；|•、,"[/') and (not after or after in ';；|•、,"]/'):
            out.append(v)
    return out


def long_cells(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """One row per (record, field) with a non-blank cell: rec_id, field_name, cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("cell")) for f in fields])).alias("c")
    return df.select(F.col(id_col).alias("rec_id"), cells).select("rec_id", "c.field_name", "c.cell").where("cell is not null and trim(cell) <> ''")


def dictionary(cells: DataFrame, name_fields: tuple[str, ...] = (), min_support: int = MIN_SUPPORT) -> DataFrame:
    """(name, value, cells): folded values with a mark inside and certain limits, of personal names (name) and of other
    fields. Counts are summed in each batch before the shuffle, so a value that stands in a third of all cells is a few rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter[tuple[bool, str]] = Counter()
            for field, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.update({(field in name_fields, v) for v in certain_values(cell)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.bool_()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["name", "value", "n"])

    return spread(cells.select("field_name", "cell")).mapInArrow(count, "name boolean, value string, n long").groupBy("name", "value").agg(F.sum("n").alias("cells")).where(F.col("cells") >= min_support)


def split_packed(df: DataFrame, id_col: str, fields: list[str], name_fields: tuple[str, ...] = ("authors",), block_chars: int = BLOCK_CHARS, lists: bool = False) -> DataFrame:
    """rec_id, field_name, pos (from 1), item: one row per value of each packed cell; with lists rec_id, field_name, items:
    one row per cell. name_fields hold personal names.

    Both passes are narrow but for the small count of dictionary values; nothing is shuffled by record."""
    spark = df.sparkSession
    cells = spread(df.select(id_col, *fields)).transform(lambda d: long_cells(d, id_col, fields))
    words = materialize(dictionary(cells, name_fields), "dictionary")
    blocks = max(1, -(-(words.agg(F.sum(F.length("value"))).first()[0] or 0) // block_chars))
    id_type = cells.schema["rec_id"].dataType.simpleString()
    cells = cells.select("*", F.array().cast("array<string>").alias("known"))
    for k in range(blocks):
        # a hash deals the values out, so each block holds about block_chars characters
        rows = words.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == k).select("name", "value").collect()
        sent = spark.sparkContext.broadcast(tuple([r.value for r in rows if r.name == name] for name in (False, True)))
        last = k == blocks - 1

        def mark(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            automata = [_automaton(v) for v in sent.value]
            for b in batches:
                names = [f in name_fields for f in b.column(1).to_pylist()]
                known = [k + (known_in(automata[n], c) if "," in c else []) for n, c, k in zip(names, *(b.column(i).to_pylist() for i in (2, 3)))]
                if not last:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(known, pa.list_(pa.string()))], ["rec_id", "field_name", "cell", "known"])
                    continue
                cut = [segment(c, set(k), n) for c, k, n in zip(b.column(2).to_pylist(), known, names)]
                if lists:
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cut, pa.list_(pa.string()))], ["rec_id", "field_name", "items"])
                    continue
                at = pa.array([i for i, values in enumerate(cut) for _ in values], pa.int64())
                pos = pa.array([p for values in cut for p in range(1, len(values) + 1)], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pos, pa.array([v for values in cut for v in values], pa.string())], ["rec_id", "field_name", "pos", "item"])

        ends = ("items array<string>" if lists else "pos int, item string") if last else "cell string, known array<string>"
        cells = cells.mapInArrow(mark, f"rec_id {id_type}, field_name string, {ends}")
    return cells


def split_packed_scopus(df: DataFrame) -> DataFrame:
    return split_packed(df, "rec_id", ["authors", "author_keywords", "index_keywords"])


def packed_names(df: DataFrame, id_col: str, field: str) -> DataFrame:
    """rec_id, items: the names of one packed cell as an array, for operators that work by record; as split_packed cuts them."""
    return split_packed(df, id_col, [field], (field,), lists=True).select("rec_id", "items")
