"""Token counts of a unigram tokenizer, by count-only Viterbi.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character; dynamic programming keeps, per
character, the best score and the number of tokens of the best path, and nothing to go back on. Rules are those of the
Unigram model of the ``tokenizers`` library behind its Metaspace step, and counts equal its own:

- spaces become U+2581, one is put in front if there is none, and each starts a new stretch that is scored on its own;
- of paths of equal score to a character, that with the earliest start of its last piece wins;
- a character that no piece of one character covers may be unknown, at the lowest score of the vocabulary less 10;
- neighbouring unknown characters are fused; a fused stretch is one token if it is a piece, else its UTF-8 bytes if the
  vocabulary has all byte pieces, else one unknown token.

The vocabulary (pieces with scores) is a file named by a parameter; only the driver reads it and it is broadcast, bounded
by ``max_pieces``. Stretches are counted once per worker and kept in a memory of at most ``remembered`` entries.

Edge cases: a null or empty text has no tokens; long stretches without a space take time in proportion to their length;
equal rows get equal rows; columns other than id and text are not touched; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

_SPACE = "▁"
_UNKNOWN_PENALTY = 10.0
_counters: dict[int, Counter] = {}


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, pieces: Sequence[tuple[str, float]], remembered: int = 1_000_000):
        import ahocorasick  # only workers that count need it

        self.pieces = {p: s for p, s in pieces if p}
        self.unknown = min(self.pieces.values(), default=0.0) - _UNKNOWN_PENALTY
        self.has_bytes = all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.remembered = remembered
        self.known: dict[str, int] = {}
        self.singles = {p for p in self.pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        if self.pieces:
            self.automaton.make_automaton()

    def count_stretch(self, text: str) -> int:
        n = len(text)
        if self.singles.issuperset(text):  # nothing can be unknown
            best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for last, (length, score) in self.automaton.iter(text):
                start = last + 1 - length
                score += best[start]
                if score > best[last + 1]:
                    best[last + 1] = score
                    count[last + 1] = count[start] + 1
            return count[n]
        best = [float("-inf")] * (n + 1)
        count, run = [0] * (n + 1), [-1] * (n + 1)  # tokens before an unknown run, and where that run starts
        best[0] = 0.0
        single = bytearray(n + 1)
        done = 0

        def total(at: int) -> int:
            return count[at] if run[at] < 0 else count[at] + self._unknown_tokens(text[run[at] : at])

        def close(at: int) -> None:
            """All pieces that end here are seen; the unknown character is the last candidate."""
            if not single[at] and (score := best[at - 1] + self.unknown) > best[at]:
                best[at] = score
                count[at] = count[at - 1]
                run[at] = run[at - 1] if run[at - 1] >= 0 else at - 1

        if self.pieces:
            for last, (length, score) in self.automaton.iter(text):
                end = last + 1
                while done < end - 1:
                    done += 1
                    close(done)
                if length == 1:
                    single[end] = 1
                score += best[end - length]
                if score > best[end]:
                    best[end] = score
                    count[end] = total(end - length) + 1
                    run[end] = -1
        while done < n:
            done += 1
            close(done)
        return total(n)

    def _unknown_tokens(self, run: str) -> int:
        if run in self.pieces or not self.has_bytes:
            return 1
        return len(run.encode())

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", _SPACE)
        stretches = text.split(_SPACE)
        if text[0] == _SPACE:
            stretches = stretches[1:]
        n, known = 0, self.known
        for s in stretches:
            c = known.get(s)
            if c is None:
                c = self.count_stretch(_SPACE + s)
                if len(s) <= 64:
                    if len(known) >= self.remembered:
                        known.clear()
                    known[s] = c
            n += c
        return n


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without its control and unknown pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


def token_counts(
    docs: DataFrame,
    pieces: Sequence[tuple[str, float]],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_pieces: int = 1_000_000,
    remembered: int = 1_000_000,
) -> DataFrame:
    """Per row: id, ``n_chars`` and ``n_tokens``. One pass, no shuffle."""
    if len(pieces) > max_pieces:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces; max_pieces is {max_pieces}")
    shared = docs.sparkSession.sparkContext.broadcast(list(pieces))
    key = hash((len(pieces), *pieces[:3], *pieces[-3:], remembered))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tierlabel.llm import tokens

        counter = tokens.counter(key, shared, remembered)
        for table in batches:
            for at in range(0, len(table), 256):
                part = table.slice(at, 256)
                texts = part.column(1).to_pylist()
                chars = pa.array([len(t or "") for t in texts], pa.int64())
                counts = pa.array([counter.count(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), chars, counts], [id_col, "n_chars", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_chars long, n_tokens long")


def counter(key: int, shared, remembered: int) -> Counter:
    """The counter of a vocabulary, built once per worker."""
    found = _counters.get(key)
    if found is None or list(found.pieces.items()) != [(p, s) for p, s in dict(shared.value).items() if p]:
        _counters.clear()
        found = _counters[key] = Counter(shared.value, remembered)
    return found
