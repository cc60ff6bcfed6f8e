"""Language identification by cross-parsing entropy.

Every language has a suffix automaton of its labelled text. A text is parsed greedily, from its first to its last letter,
into the longest phrases that occur in that training text. The phrases are normalised by the size of the training
text (a phrase costs log2 of it) and by the letters of the text; the language that needs the fewest wins. Texts are read whole, as
lower-case letters with runs of anything else as one space.

The parse runs over windows of WINDOW letters side by side, and is the parse of the whole text all the same: the phrase that
a window begins inside of is carried over from the window before, until it and the window's own parse cut at one place.

Training takes at most SAMPLE_CHARS characters of each language, from rows in the order of a hash of doc_id (about
SAMPLE_ROWS rows at first); both are parameters. A row longer than that gives the tenth part of SAMPLE_CHARS from its middle, or
SAMPLE_CHARS where the language has too little otherwise; further rows are drawn while a sample is not full. Everything
else covers all rows.

Defined cases: null text or text without a letter gives `und` with score 0; a letter that no training text
has is a phrase of its own; ties go to the least language name; without training rows every text is `und`; an empty
table gives an empty result; columns other than doc_id, text and lang are ignored or pass through, whatever their names,
and lang only labels training rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read, tidy

SAMPLE_CHARS = 40_000
SAMPLE_ROWS = 400
WINDOW = 512
UND = "und"
_LANES = 1 << 12
#: Cells of a language's transition table up to which it is kept as a table.
DENSE_CELLS = 1 << 24


def _lower_letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space where it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()[0]
            table[k] = ord(low) if low.isalpha() else k
    return table


_LETTERS: list[np.ndarray] = []


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, one after the other, as lower-case letters with runs of anything else as one inner space; and their sizes."""
    if not _LETTERS:
        _LETTERS.append(_lower_letters())
    sizes = np.array([len(t) for t in texts], np.int64)
    marks = _LETTERS[0][np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(sizes)
    space = marks == 32
    after_space = np.empty(len(marks), bool)
    after_space[1:] = space[:-1]
    after_space[(ends - sizes)[sizes > 0]] = True
    keep = ~(space & after_space)
    held = np.concatenate(([0], np.cumsum(keep)))
    at_end = np.flatnonzero(keep)[held[ends[held[ends] > held[ends - sizes]]] - 1]  # the last character kept of each text
    keep[at_end[space[at_end]]] = False
    held = np.concatenate(([0], np.cumsum(keep)))
    return marks[keep], held[ends] - held[ends - sizes]


def normalise(text: str) -> str:
    return normalised([text])[0].tobytes().decode("utf-32-le", "surrogatepass")


class SuffixAutomaton:
    """Suffix automaton over small integer symbols; -1 is no transition.

    Transitions are one table of states times symbols where that is small, else sorted keys state * alphabet + symbol.
    """

    def __init__(self, symbols: list[int], alphabet: int, dense_cells: int = DENSE_CELLS):
        nexts, link, length, last = [{}], [-1], [0], 0
        for c in symbols:
            cur = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = link[p]
            if p != -1:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.alphabet = alphabet
        keys = np.array([state * alphabet + c for state, row in enumerate(nexts) for c in sorted(row)], np.int64)
        to = np.array([row[c] for row in nexts for c in sorted(row)], np.int32)
        if len(nexts) * alphabet <= dense_cells:
            self.flat = np.full(len(nexts) * alphabet, -1, np.int32)
            self.flat[keys] = to
            self.one = memoryview(self.flat).__getitem__
            self.many = self.flat.__getitem__
        else:
            known = dict(zip(keys.tolist(), to.tolist()))
            self.one = lambda key: known.get(key, -1)
            self.many = lambda at: self._search(keys, to, at)

    @staticmethod
    def _search(keys: np.ndarray, to: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(at), -1, np.int32)
        place = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
        return np.where(keys[place] == at, to[place], np.int32(-1))


class CrossParser:
    """Phrase counts of texts against the training text of each language."""

    def __init__(self, samples: dict[str, str], dense_cells: int = DENSE_CELLS):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s} | {" "})
        self.alphabet = len(letters) + 1  # the last symbol stands for characters that no sample has
        self.codes = np.full(0x110000, self.alphabet - 1, np.uint8 if self.alphabet < 256 else np.int32)
        for k, c in enumerate(letters):
            self.codes[ord(c)] = k
        at = {c: k for k, c in enumerate(letters)}
        self.automata = [SuffixAutomaton([at[c] for c in samples[lang]], self.alphabet, dense_cells) for lang in self.langs]
        self.weights = np.array([np.log2(max(len(samples[lang]), 2)) for lang in self.langs])

    def _parse(self, automaton: SuffixAutomaton, grid: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases start, and the last state, of lanes that are each parsed on their own; lanes stand in order of falling size."""
        width, many = self.alphabet, automaton.many
        state, starts = np.zeros(len(sizes), np.int64), np.zeros(grid.shape, bool)
        alive = np.searchsorted(-sizes, -np.arange(len(grid)), side="left")
        for step, m in enumerate(alive.tolist()):
            c, now = grid[step, :m], state[:m]
            to = many(now * width + c)
            stuck = np.flatnonzero(to < 0)
            starts[step, :m] = now == 0
            if len(stuck):
                starts[step, stuck] = True
                again = many(c[stuck])
                again[again < 0] = 0
                to[stuck] = again
            state[:m] = to
        return starts, state

    def _carried(self, automaton: SuffixAutomaton, state: int, window: np.ndarray, starts: np.ndarray, total: int, last: int) -> tuple[int, int]:
        """Phrases that start in a window, and its last state, where a phrase in `state` runs into it; starts, total and last are its own parse's."""
        width, one, count, passed, known = self.alphabet, automaton.one, 0, 0, []
        for place in range(len(window)):
            if place == len(known):
                known = window[: 2 * place + 32].tolist()
            c, own = known[place], bool(starts[place])
            to = one(state * width + c)
            if state == 0 or to < 0:
                if own:  # both parses cut here and go on alike
                    return count + total - passed, last
                count += 1
                if to < 0:
                    to = max(one(c), 0)
            passed += own
            state = to
        return count, state

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (row) and language (column), and each text's letters."""
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        marks, sizes = normalised(texts)
        whole = self.codes[marks]
        owner = np.repeat(np.arange(len(texts)), -(-sizes // WINDOW))
        starts_at = np.concatenate([np.arange(0, n, WINDOW) for n in sizes.tolist()] or [np.empty(0, np.int64)]).astype(np.int64)
        base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        carry = [0] * len(self.langs)  # the state in which each language's parse leaves the window before
        for k in range(0, len(owner), _LANES):
            who, start = owner[k : k + _LANES], starts_at[k : k + _LANES]
            size = np.minimum(WINDOW, sizes[who] - start)
            order = np.argsort(-size, kind="stable")
            lane = np.argsort(order)
            index = (base[who] + start)[order][None, :] + np.arange(int(size.max()))[:, None]
            grid = whole[np.minimum(index, len(whole) - 1, out=index)].astype(np.int32)
            del index
            later = np.flatnonzero(start > 0).tolist()
            for j, automaton in enumerate(self.automata):
                starts, states = self._parse(automaton, grid, size[order])
                totals, ends = starts.sum(0)[lane], states[lane].tolist()
                before = {-1: carry[j]}
                for w in later:
                    state = before[-1] if w == 0 else ends[w - 1]
                    if state:
                        at, n = int(lane[w]), int(size[w])
                        totals[w], ends[w] = self._carried(automaton, state, grid[:n, at], starts[:n, at], int(totals[w]), ends[w])
                carry[j] = ends[-1]
                np.add.at(found[:, j], who, totals)
        return found, sizes

    def rates(self, texts: list[str]) -> np.ndarray:
        """Phrases for each letter; NaN where a text has no letter."""
        found, sizes = self.phrases(texts)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(sizes[:, None] > 0, found / sizes[:, None], np.nan)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[int]]:
        """Language, score, its phrases for each letter, and letters; the score is 1 - cost / (cost + runner-up's cost), over 0.5 for a clear winner."""
        known = [t or "" for t in texts]
        rates = self.rates(known) if self.langs else np.full((len(texts), 1), np.nan)
        langs, scores, least = [], [], []
        for row in rates:
            if np.isnan(row[0]):
                langs.append(UND), scores.append(0.0), least.append(None)
                continue
            cost = row * self.weights
            order = np.argsort(cost, kind="stable")
            langs.append(self.langs[order[0]])
            second = cost[order[1]] if len(row) > 1 else cost[order[0]]
            scores.append(float(second / (cost[order[0]] + second)))
            least.append(float(row[order[0]]))
        return langs, scores, least, normalised(known)[1].tolist()


_PARSERS: dict[int, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    """One parser for each worker and model."""
    key = zlib.crc32(repr(sorted(samples.items())).encode())
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = CrossParser(samples)
    return _PARSERS[key]


def held_out(doc_id):
    """True for the third of the rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_samples(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, sample_rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Up to sample_chars normalised characters of each language from about sample_rows rows that are not held out, or more rows while they don't suffice."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("_rank", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(2**31)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = F.length("text")
    middle = F.when(size <= sample_chars, F.col("text")).otherwise(F.substring(F.col("text"), F.floor((size - sample_chars) / 2).cast("int") + 1, F.lit(sample_chars)))
    share, all_ranks = max(1, sample_chars // 10), 2**31
    drawn: dict[str, list[tuple[str, str]]] = {lang: [] for lang in counts}  # for each row its share and all that was read of it
    samples: dict[str, str] = {}
    low, high = dict.fromkeys(counts, -1), {lang: int(min(1.0, sample_rows / n) * all_ranks) for lang, n in counts.items()}
    while high:
        bounds = [F.create_map(*[x for lang, to in sorted(ends.items()) for x in (F.lit(lang), F.lit(to))])[F.col("lang")] for ends in ({k: low[k] for k in high}, high)]
        rows = known.where((F.col("_rank") > bounds[0]) & (F.col("_rank") <= bounds[1])).select("lang", middle.alias("text"), "_rank", F.col("doc_id").cast("string").alias("_id"), (size > sample_chars).alias("_long"))
        for r in sorted(rows.toLocalIterator(), key=lambda r: (r["_rank"], r["_id"] or "", r["text"])):
            held = drawn[r["lang"]]
            if sum(len(part) for part, _ in held) < sample_chars:
                start = (len(r["text"]) - share) // 2
                whole = normalise(r["text"])
                held.append((normalise(r["text"][start : start + share]) if r["_long"] else whole, whole))
        for lang in high:
            # Long rows give their shares while those suffice, then all that was read of them.
            texts = [" ".join(parts) for parts in zip(*drawn[lang])] or [""]
            samples[lang] = (texts[0] if len(texts[0]) >= sample_chars else texts[-1])[:sample_chars]
        low |= high
        high = {lang: min(all_ranks, 4 * to + 1) for lang, to in high.items() if len(samples[lang]) < sample_chars and to < all_ranks}
    return {lang: text for lang, text in samples.items() if drawn[lang]}


def annotate(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(row, lang_pred, score, phrase_rate, letters): every row of docs as one struct, so that no name can clash, and what its text says."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            found: list[list] = [[], [], [], []]
            texts, size, start = batch.column(0).flatten()[place], 0, 0
            for i in range(len(batch)):
                size += len(texts[i].as_buffer()) if texts[i].is_valid else 0
                if size > 2_000_000 or i == len(batch) - 1:
                    for all_of, some in zip(found, parser.predict(texts.slice(start, i + 1 - start).to_pylist())):
                        all_of += some
                    start, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.float64(), pa.int64()))]], names=["row", "lang_pred", "score", "phrase_rate", "letters"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    added = StructType.fromDDL("lang_pred string, score double, phrase_rate double, letters long")
    return rows.mapInArrow(tidy(run), StructType(rows.schema.fields + added.fields))


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, phrase_rate) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return annotate(rows, samples).select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")


def accepted(docs: DataFrame, samples: dict[str, str], max_rate: float = 0.5) -> DataFrame:
    """The rows whose text is in a known language: it has a letter, and its phrases but for the last, which ends with the text, are no more than max_rate for each letter."""
    good = (F.col("lang_pred") != UND) & (F.col("phrase_rate") * F.col("letters") - 1 <= max_rate * F.col("letters"))
    return annotate(docs, samples).where(good).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, training_samples(docs))
