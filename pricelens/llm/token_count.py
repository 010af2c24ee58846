"""Token counts by a Viterbi search that carries counts only.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each
character.  The search keeps, per character, the best score and the number of
pieces on the way there; no path is stored.  Ties follow the public unigram
tokenizer: a later start replaces an earlier one only with a higher score, so the
longer last piece wins.  A character that is no piece by itself costs the lowest score
less 10; it counts as its UTF-8 bytes, or one for each run without byte pieces.

The vocabulary's word mark stands only at the head of pieces, so no piece crosses a
word's start, and a text's best path is its words' best paths.  Words are searched once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import row_key
from pricelens.llm.word_ids import worker_state

MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``bytes_too``: unknown characters fall back to byte pieces."""

    pieces: dict[str, float]
    bytes_too: bool

    @property
    def unknown(self) -> float:
        return min(self.pieces.values()) - 10


def load_vocabulary(path: str) -> Vocabulary:
    """Pieces of a public sentence-piece file, without control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = range(m.get_piece_size())
    pieces = {m.id_to_piece(i): m.get_score(i) for i in n if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
    return Vocabulary(pieces, any(m.is_byte(i) for i in n))


class Counter:
    """Counts the pieces of marked text (blanks as word marks)."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 400_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, score in vocabulary.pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.unknown, self.bytes_too, self.limit = vocabulary.unknown, vocabulary.bytes_too, limit
        # cut before a mark only if no piece goes on across one
        apart = not any(MARK in p.lstrip(MARK) for p in vocabulary.pieces)
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if apart else re.compile("(?s).+")
        self.memo: dict[str, tuple[float, int]] = {}

    def search(self, word: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n, unknown = len(word), self.unknown
        best = [0.0] + [float("-inf")] * n
        count, open_run = [0] * (n + 1), [False] * (n + 1)

        def lonely(e: int) -> None:
            """The character before ``e`` is no piece: it may be unknown, at its cost."""
            s = e - 1
            if best[s] + unknown > best[e]:
                best[e], open_run[e] = best[s] + unknown, True
                count[e] = count[s] + (len(word[s].encode()) if self.bytes_too else int(not open_run[s]))

        done, alone = 0, True
        # ends ascend; of the matches with one end the longest comes first
        for end, (size, score) in self.automaton.iter(word):
            e = end + 1
            while done < e:
                if not alone:
                    lonely(done)
                done, alone = done + 1, False
            alone = alone or size == 1
            value = best[e - size] + score
            if value > best[e]:
                best[e], count[e], open_run[e] = value, count[e - size] + 1, False
        while done < n:
            if not alone:
                lonely(done)
            done, alone = done + 1, False
        if n and not alone:
            lonely(n)
        return best[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        score, pieces, memo = 0.0, 0, self.memo
        for word in self.words.findall(MARK + text.replace(" ", MARK)) if text else ():
            found = memo.get(word)
            if found is None:
                found = memo[word] = self.search(word)
            score += found[0]
            pieces += found[1]
        if len(memo) > self.limit:
            memo.clear()
        return score, pieces


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, row_key, n_chars, n_tokens, score.

    Blanks become word marks and one is put before the text; other white space is
    ordinary text.  Null and empty texts have no tokens and score 0.  Repeated rows
    are kept; columns besides the two named are ignored.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
    )
    kind = keyed.select("doc", "row_key").schema.simpleString()[len("struct<"):-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"pieces:{vocabulary_path}", lambda: Counter(load_vocabulary(vocabulary_path)))
        for b in batches:
            rows = []
            for value in b.column(2):
                text = value.as_py()
                score, pieces = counter.count(text)
                rows.append((len(text), pieces, score))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["doc", "row_key", "n_chars", "n_tokens", "score"],
            )

    return keyed.mapInArrow(run, kind + ", n_chars bigint, n_tokens bigint, score double").withColumnRenamed("doc", id_col)
