"""Subject area of each document: weighted terms, an automaton, calibrated thresholds.

Terms are curated from the labelled documents, not written down here: words and word pairs (in
either order, so that "dropout (school)" counts as "school dropout") whose documents bear one
subject far more often than chance. The sample of labelled documents is bounded by FIT_DOCS; what
is counted beside it (rarity of terms, words of sentences without a subject, terms of assigned
documents) is counted over all documents.

0. Fold every text once, into a table of its sentences; all later passes read that table.
1. Count terms by subject in the labelled documents; keep those whose lower confidence bound lies far
   above the subject's share of all labels.
2. Over all documents, count how often each word stands in sentences without such a term. Words
   that mostly do (of maps, networks, corpora, citations) mark sentences without a subject,
   whatever words they borrow.
3. Count terms again without those sentences; assign with them the subjects of all documents (those of
   the sample keep their labels), and count once more over these, so that terms which few labelled
   documents hold, as in the rarer languages, come in too. At any size and number of labels this is
   one pass, whose counts are summed before they are shuffled.
4. Choose each subject's threshold for sentences by the labels of held-out documents, of which no term
   was learnt: the one with the best F, where few held-out labels lean on those of all subjects.
5. Match all documents: an automaton finds the terms of each sentence, a sentence's subject is the
   one with the greatest weight (purity x rarity) beyond the threshold, and a document gets every
   subject of at least SHARE of its sentences. A sentence counts for one subject.

Defined results: null, empty and blank texts and texts without a subject have no row; labels are
matched to the subjects by case, blanks and one or two letters, others are ignored; repeated labels
count once; without labels or subjects nothing is assigned; very long texts are read whole.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, rows_bounded, spread
from .leakage import words_of

#: Labelled documents of the sample, least documents of a term, width of its confidence interval, share
#: of sentences. SHARE is a fifth, less what uneven sentence ends take.
FIT_DOCS, SUPPORT, Z, SHARE = 20_000, 4, 2.0, 0.18
#: One in HELD labelled documents is held out for the thresholds; held-out labels that weigh as much as those of all subjects.
HELD, LEANS = 5, 20
#: How far from a subject's share of the labels to 1 a term's lower bound and its purity must lie, and from
#: where on a word leans to a subject and so is no mark of sentences without one.
GAIN_LOW, GAIN, LEAN = 0.38, 0.55, 0.25
#: Share of its sentences without a term that makes a word a mark of such sentences, how many marks
#: make a sentence one, thresholds tried, and the most subjects, labels as written and dictionary terms that are sent (more are an error).
MARK, MARKS, TRIED, MOST_SUBJECTS, MOST_TERMS = 0.85, 3, (0.35, 0.5, 0.65, 0.8, 1.0, 1.25), 1_000, 2_000_000
_END = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*•#>]|\d+[.)]\s|[A-Z]{2,4}\s*-\s|(?:PT|TI|SO|DE|ID|AB|PY|ER|AU)\s))|\s\|\s|(?<=[.!?;])\s+|(?<=[.!?])(?=[^\W\d_a-z])")


def stem(w: str) -> str:
    return w[:-1] if len(w) > 4 and w[-1] == "s" and w[-2] != "s" else w


def sentences(text: str | None) -> list[list[str]]:
    """Folded words of each sentence of four words or more."""
    out = []
    for s in _END.split(text or ""):
        w = [stem(x) for x in words_of(s)] if s else []
        if len(w) >= 4:
            out.append(w)
    return out


def terms_of(words: list[str]) -> set[str]:
    """Words and unordered pairs of neighbours."""
    out = {w for w in words if len(w) > 3 and not w[0].isdigit()}
    for a, b in zip(words, words[1:]):
        if not a[0].isdigit() and not b[0].isdigit():
            out.add(f"{a} {b}" if a < b else f"{b} {a}")
    return out


class Matcher:
    """Automaton over the terms, both orders of a pair; weights by purity and rarity."""

    def __init__(self, terms: dict[str, tuple[str, float]], marks: Iterable[str] = (), threshold: float = 0.0, own: dict[str, float] | None = None):
        self.terms, self.marks, self.threshold, self.own = terms, frozenset(marks), threshold, own or {}
        self._a: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "marks": self.marks, "threshold": self.threshold, "own": self.own, "_a": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._a is None:
            a = ahocorasick.Automaton()
            for t in self.terms:
                a.add_word(f" {t} ", t)
                if " " in t:
                    a.add_word(f" {' '.join(t.split(' ')[::-1])} ", t)
            if self.terms:
                a.make_automaton()
            self._a = a
        return self._a

    def found(self, words: list[str]) -> set[str]:
        return {t for _, t in self.automaton().iter(f" {' '.join(words)} ")} if self.terms else set()

    def bare(self, words: list[str]) -> bool:
        return bool(self.marks) and len(self.marks.intersection(words)) >= MARKS

    def weigh(self, words: list[str]) -> tuple[str, float] | None:
        """Best subject of a sentence and its weight."""
        if self.bare(words):
            return None
        total: Counter[str] = Counter()
        for t in self.found(words):
            s, w = self.terms[t]
            total[s] += w
        return max(total.items(), key=lambda x: (x[1], x[0])) if total else None

    def tried(self, all_of: list[list[str]], thresholds: tuple[float, ...]) -> list[dict[str, float]]:
        """Share of the sentences by subject, for each threshold."""
        best = [b for b in map(self.weigh, all_of) if b]
        return [{s: n / len(all_of) for s, n in Counter(s for s, w in best if w >= t).items()} for t in thresholds]

    def shares(self, all_of: list[list[str]]) -> dict[str, float]:
        """Share of the sentences by subject, by each subject's own threshold."""
        n = Counter(b[0] for b in map(self.weigh, all_of) if b and b[1] >= self.own.get(b[0], self.threshold))
        return {s: k / len(all_of) for s, k in n.items()}


def _said(column: pa.Array) -> list[list[list[str]]]:
    """The words of each sentence of each folded text."""
    return [[s.split(" ") for s in t or ()] for t in column.to_pylist()]


def fold(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, said (the folded sentences, words between blanks) of each document with any: a table, written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[" ".join(w) for w in sentences(t)] for t in b.column(1).to_pylist()], pa.list_(pa.string()))], ["doc_id", "said"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.length(text) > 0)
    return materialize(spread(source).mapInArrow(work, "doc_id long, said array<string>").where(F.size("said") > 0), "said")


def clean_labels(labels: DataFrame, subjects: list[str]) -> dict[str, str]:
    """Label as written -> subject, for the distinct labels (more than MOST_TERMS spellings are an error)."""
    known = {s.strip().lower(): s for s in subjects}
    out = {}
    spelt = labels.where("subject is not null").select("subject").distinct()
    if not rows_bounded(spelt, MOST_TERMS):
        raise ValueError(f"more than {MOST_TERMS} spellings of labels")
    for r in spelt.collect():
        folded = " ".join(r["subject"].lower().split())
        near = [folded] if folded in known else difflib.get_close_matches(folded, known, 1, 0.72)
        if near:
            out[r["subject"]] = known[near[0]]
    return out


def _term_counts(fit: DataFrame, matcher: Matcher | None, taught: Matcher | None = None) -> DataFrame:
    """term ('' for the documents themselves), subject ('' for all documents), n over the documents (said, subjects) that
    have a subject; where subjects is null, taught assigns them."""
    sent = fit.sparkSession.sparkContext.broadcast((matcher, taught))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, assign = sent.value
        for b in batches:
            n: Counter[tuple[str, str]] = Counter()
            for all_of, subjects in zip(_said(b.column(0)), b.column(1).to_pylist()):
                if not subjects and assign:
                    subjects = [s for s, v in assign.shares(all_of).items() if v >= SHARE]
                if not subjects:
                    continue
                held = {""}
                for w in all_of:
                    if m is None or not m.bare(w):
                        held |= terms_of(w)
                for t in held:
                    n[t, ""] += 1
                    for s in subjects:
                        n[t, s] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "subject", "k"])

    return fit.mapInArrow(count, "term string, subject string, k long").groupBy("term", "subject").agg(F.sum("k").alias("n"))


def _top(counts: DataFrame, least: int, prior: DataFrame) -> DataFrame:
    """term, subject (its most frequent), n, p (share of its documents), q (share of all labelled documents)."""
    by = counts.where("term <> ''").groupBy("term").agg(F.max(F.when(F.col("subject") == "", F.col("n"))).alias("n"), F.max(F.when(F.col("subject") != "", F.struct("n", "subject"))).alias("top")).where(F.col("n") >= least)
    return by.select("term", "n", (F.col("top.n") / F.col("n")).alias("p"), F.col("top.subject").alias("subject")).join(F.broadcast(prior), "subject")


def _choose(counts: DataFrame, labelled: int, prior: DataFrame) -> dict[str, tuple[str, float]]:
    """Terms with their subject and purity: the lower Wilson bound of the share decides, against the subject's
    share of the labelled documents (prior: subject, q)."""
    p, n, z2 = F.col("p"), F.col("n"), Z * Z
    low = (p + z2 / (2 * n) - Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    beyond = lambda g: F.col("q") + g * (1 - F.col("q"))
    rows = _top(counts, max(SUPPORT, labelled // 1000), prior).where((low >= beyond(GAIN_LOW)) & (p >= beyond(GAIN))).select("term", "subject", "p")
    # a term needs a thousandth of the documents that have a subject, so there are fewer than 1000 x terms of a document
    if not rows_bounded(rows, MOST_TERMS):
        raise ValueError(f"more than {MOST_TERMS} terms")
    return {r["term"]: (r["subject"], r["p"]) for r in rows.collect()}


def _leaning(counts: DataFrame, labelled: int, prior: DataFrame) -> set[str]:
    """Single words whose documents bear one subject more often than others do."""
    rows = _top(counts, max(SUPPORT, labelled // 1000), prior).where("instr(term, ' ') = 0").where(F.col("p") >= F.col("q") + LEAN * (1 - F.col("q")))
    return {r["term"] for r in rows.select("term").collect()}


def fit_matcher(said: DataFrame, labels: DataFrame, subjects: DataFrame) -> Matcher | None:
    """The matcher for documents as `fold` gives them."""
    spark = said.sparkSession
    if not rows_bounded(subjects, MOST_SUBJECTS):
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    written = clean_labels(labels.select("subject"), [r["subject"] for r in subjects.select("subject").where("subject is not null").distinct().collect()])
    if not written:
        return None
    pairs = spark.createDataFrame(list(written.items()), "subject string, area string")
    areas = labels.select(F.col("doc_id"), "subject").join(pairs, "subject").groupBy("doc_id").agg(F.array_sort(F.collect_set("area")).alias("areas"))
    sample = areas.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    fold_of = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD)) == 0
    known = materialize(spread(said.join(F.broadcast(sample), "doc_id")).select("doc_id", "said", "areas", fold_of.alias("held")), "known")
    fit = known.where("not held").select("said", "areas")
    labelled = fit.count()
    if not labelled:
        return None
    prior = fit.select(F.explode("areas").alias("subject")).groupBy("subject").agg((F.count(F.lit(1)) / labelled).alias("q"))
    counts = _term_counts(fit, None).persist()
    first, leaning = Matcher(_choose(counts, labelled, prior)), _leaning(counts, labelled, prior)
    counts.unpersist()
    sent = spark.sparkContext.broadcast(first)

    def usage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, sentences with it, of them without a term) and (term, documents), (null: sentences and documents)."""
        m = sent.value
        for b in batches:
            n, bare, df, total, texts = Counter(), Counter(), Counter(), 0, 0
            for all_of in _said(b.column(0)):
                held: set[str] = set()
                texts += 1
                for w in all_of:
                    total += 1
                    found = m.found(w)
                    held |= found
                    own = set(w)
                    n.update(own)
                    if not found:
                        bare.update(own)
                df.update(held)
            words = [*(("w", x, k, bare.get(x, 0)) for x, k in n.items()), *(("t", x, k, 0) for x, k in df.items()), ("n", "", total, texts)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in words], pa.string() if i < 2 else pa.int64()) for i in range(4)], ["kind", "word", "k", "b"])

    used = said.select("said").mapInArrow(usage, "kind string, word string, k long, b long").groupBy("kind", "word").agg(F.sum("k").alias("k"), F.sum("b").alias("b")).persist()
    total = used.where("kind = 'n'").first()
    n_sentences, n_docs = (total["k"], total["b"]) if total else (0, 0)
    # words of at least one sentence in 2000: fewer than 2000 x words of a sentence
    marks = [r["word"] for r in used.where((F.col("kind") == "w") & (F.col("k") >= max(15, n_sentences // 2000)) & (F.col("b") >= MARK * F.col("k"))).select("word").collect() if r["word"] not in leaning]
    df = {r["word"]: r["k"] for r in used.where("kind = 't'").select("word", "k").collect()}
    used.unpersist()
    bare = Matcher({}, marks)
    chosen = _choose(_term_counts(fit, bare), labelled, prior)
    span = math.log(n_docs + 2)

    def weigh(chosen: dict[str, tuple[str, float]]) -> dict[str, tuple[str, float]]:
        return {t: (s, p * (1.6 if " " in t else 0.8) * (0.5 + math.log((n_docs + 2) / (df.get(t, SUPPORT) + 1)) / span)) for t, (s, p) in chosen.items()}

    taught = Matcher(weigh(chosen), marks, TRIED[len(TRIED) // 2])
    own = sample.where(~fold_of)  # the held-out documents are assigned like any other
    wider = _term_counts(said.join(F.broadcast(own), "doc_id", "left").select("said", "areas"), bare, taught).persist()
    of = {r["subject"]: r["n"] for r in wider.where("term = ''").collect()}
    n = of.pop("")
    shares = spark.createDataFrame([(s, k / n) for s, k in of.items()], "subject string, q double")
    chosen = _choose(wider, n, shares) | chosen
    wider.unpersist()
    matcher = Matcher(weigh(chosen), marks)
    ready = spark.sparkContext.broadcast(matcher)

    def agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ready.value
        for b in batches:
            n: Counter[tuple[int, str, str]] = Counter()
            for all_of, areas in zip(_said(b.column(0)), b.column(1).to_pylist()):
                for i, shares in enumerate(m.tried(all_of, TRIED)):
                    got = {s for s, v in shares.items() if v >= SHARE}
                    for kind, which in (("hit", got & set(areas)), ("wrong", got - set(areas)), ("missed", set(areas) - got)):
                        n.update((i, s, kind) for s in which)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.int32()), pa.array([k[1] for k in n], pa.string()), pa.array([k[2] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["i", "subject", "kind", "k"])

    # subjects x thresholds x 3 rows
    rows = known.where("held").select("said", "areas").mapInArrow(agreement, "i int, subject string, kind string, k long").groupBy("i", "subject", "kind").agg(F.sum("k").alias("n")).collect()
    matcher.threshold, matcher.own = thresholds([(r["i"], r["subject"], r["kind"], r["n"]) for r in rows])
    return matcher


def thresholds(counts: list[tuple[int, str, str, int]]) -> tuple[float, dict[str, float]]:
    """(of all subjects, by subject): the threshold with the best F over held-out labels; a subject's counts are joined by
    those of all subjects, scaled to LEANS labels."""
    middle = len(TRIED) // 2
    every: Counter[tuple[int, str]] = Counter()
    by: dict[str, Counter[tuple[int, str]]] = {}
    for i, s, kind, n in counts:
        every[i, kind] += n
        by.setdefault(s, Counter())[i, kind] += n
    total = max(1, every[0, "hit"] + every[0, "missed"])

    def best(own: Counter[tuple[int, str]], lean: float) -> float:
        n = lambda i, kind: own[i, kind] + lean * every[i, kind]
        f = [2 * n(i, "hit") / max(1e-9, 2 * n(i, "hit") + n(i, "wrong") + n(i, "missed")) for i in range(len(TRIED))]
        return TRIED[max(range(len(TRIED)), key=lambda i: (round(f[i], 9), -abs(i - middle), -i))]

    return best(every, 0.0), {s: best(c, LEANS / total) for s, c in by.items()}


def assign(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """doc_id, subject, share for every document and each subject of at least SHARE of its sentences."""
    spark = docs.sparkSession
    schema = "doc_id long, subject string, share double"
    said = fold(docs, doc_id, text)
    matcher = fit_matcher(said, labels, subjects)
    if matcher is None:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(matcher)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            rows = [(d, s, round(v, 6)) for d, all_of in zip(b.column(0).to_pylist(), _said(b.column(1))) for s, v in m.shares(all_of).items() if v >= SHARE]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "subject", "share"])

    return said.mapInArrow(match, schema)


def makeup(assigned: DataFrame) -> DataFrame:
    """subject, docs, mean_share: the make-up of the corpus."""
    return assigned.groupBy("subject").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("share"), 6).alias("mean_share"))
