"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both encodings must agree.

A chunk starts and ends at a blank. Two neighbours share ``overlap`` characters; the splice is a token boundary of both,
in front of a blank that follows another character, with the same pieces around it. Such a boundary is stable because
no piece of the vocabulary holds a blank after another character, which ``CountingTokenizer`` verifies when it loads:
no merge can cross it, however long the text is. Where the overlap holds none (one word longer than the overlap), it is
doubled, up to the whole text.

Nulls: a null text is empty, with 0 bytes and 0 tokens; a null doc_id stays null. Repeated rows are counted each. An
empty table gives no row. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import pieces, text_column

BLANK = "▁"


class CountingTokenizer:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        #: Characters of each piece; of the bytes of a character that has no piece, the first counts.
        self.chars = np.array([(0 if 0x80 <= int(x[1:-1], 16) < 0xC0 else 1) if self.sp.is_byte(i) else len(x) for i, x in enumerate(names)])
        #: No piece crosses from another character to a blank, and a lone blank in front of a word is the one a text starts with.
        self.stable = not any(BLANK in x.lstrip(BLANK) for x in names) and self.sp.encode("b c") == self.sp.encode("b") + self.sp.encode("c")

    def count(self, text: str, chunk: int, overlap: int) -> int:
        if len(text) <= chunk or not self.stable:
            return len(self.sp.encode(text))
        return sum(1 for _ in self.spliced(text, chunk, overlap))

    def spliced(self, text: str, chunk: int, overlap: int) -> Iterator[int]:
        """ids of the whole text, from chunks."""
        at, end = 0, self._cut(text, chunk)
        left = self._ids(text, at, end)
        while end < len(text):
            wide = overlap
            while True:
                start = self._cut(text, max(0, end - wide), back=True)
                to = self._cut(text, end + chunk)
                right = self._ids(text, start, to)
                splice = self._agree(text, left, right, start, end)
                if splice is not None:
                    break
                if start <= at:  # the overlap is the whole of the left chunk: join both
                    left, end = self._ids(text, at, to), to
                    break
                wide *= 2
            if splice is None:
                continue
            i, j = splice
            yield from (x[1] for x in left[:i])
            left, at, end = right[j:], right[j][0], to
        yield from (x[1] for x in left)

    @staticmethod
    def _cut(text: str, at: int, back: bool = False) -> int:
        """The next (or last) place in front of a lone blank that follows another character; an end of the text if none."""
        if at >= len(text):
            return len(text)
        while True:
            at = text.rfind(" ", 0, at + 1) if back else text.find(" ", at)
            if at <= 0:
                return 0 if back else len(text)
            if text[at - 1] not in " " + BLANK and text[at + 1 : at + 2] not in ("", " ", BLANK):
                return at
            at += -1 if back else 1

    def _ids(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        """(place, id) of the tokens of text[start:end]; its leading blank is the one that the library puts before a text."""
        ids = self.sp.encode(text[start + (start > 0) : end])
        place = np.cumsum([start - (start == 0), *self.chars[ids[:-1]]]) if ids else []
        return list(zip(map(int, place), ids))

    @staticmethod
    def _agree(text: str, left: list[tuple[int, int]], right: list[tuple[int, int]], start: int, end: int) -> tuple[int, int] | None:
        """Indexes in left and right of a boundary in front of a blank inside the overlap, the pieces after it equal up to the next one."""
        mine = {p: k for k, (p, _) in enumerate(left) if p > start}
        places = [(mine[p], j) for j, (p, _) in enumerate(right) if p in mine and text[p] == " " and text[p - 1] not in " " + BLANK]
        half = len(places) // 2
        for (k, j), (k2, j2) in [*zip(places[half:], places[half + 1 :]), *zip(places, places[1:])]:
            if [x[1] for x in left[k:k2]] == [x[1] for x in right[j:j2]]:
                return k, j
        return None


_LOADED: dict[str, CountingTokenizer] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, chunk: int = 16_384, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = CountingTokenizer(tokenizer)
        tok = _LOADED[tokenizer]
        for b in pieces(batches, "text"):
            texts, n = text_column(b, "text"), []
            for i in range(0, len(texts), 64):
                some = texts[i : i + 64]
                small = [t for t in some if len(t) <= chunk or not tok.stable]
                short = iter([len(x) for x in tok.sp.encode(small, num_threads=1)] if small else [])
                n += [next(short) if len(t) <= chunk or not tok.stable else tok.count(t, chunk, overlap) for t in some]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
