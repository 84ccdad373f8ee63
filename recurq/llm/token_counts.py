"""Token counts of texts under a public byte-level BPE tokenizer.

Every text is cut into pre-tokens, the tokenizer's own units, which no merge crosses. Within a block of
texts the distinct pre-tokens form one table, pieces are counted once for each of its rows, and that table
is joined to the pre-token frequencies of each document; counts are sums of frequency times pieces. No
ids of a document are kept. The table of a task outlives its block, up to ``memo_entries`` rows; when it is full it
starts anew, which costs time and changes no result. Nothing shuffles, so no key can be hot.

Cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; a special token's
string inside a text counts as one token, the library's default; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern for texts below U+0250, with the classes written out.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceCounter:
    """Counts the tokens of texts with the tokenizer in the JSON file ``path``."""

    def __init__(self, path: str, memo_entries: int = 400_000, memo_chars: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._tokenize = tokenizer.model.tokenize
        self._alphabet = byte_alphabet()
        self._latin, self._any = re.compile(LATIN_PATTERN), regex.compile(PATTERN)
        self._beyond = re.compile("[^\x00-ɏ]")
        added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._added = re.compile("|".join(map(re.escape, added))) if added else None
        self._memo: dict[str, int] = {}
        self._entries, self._chars = memo_entries, memo_chars

    def pieces(self, pre_token: str) -> int:
        """The number of pieces of one pre-token."""
        return len(self._tokenize(pre_token.encode("utf-8", "replace").decode("latin-1").translate(self._alphabet)))

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """The pre-tokens of a text with their frequencies, and the number of added tokens in it."""
        parts, added = [text], 0
        if self._added is not None and self._added.search(text):
            parts = self._added.split(text)
            added = len(parts) - 1
        found: Counter = Counter()
        for part in parts:
            found.update((self._any if self._beyond.search(part) else self._latin).findall(part))
        return found, added

    def count(self, texts: list[str | None]) -> list[int]:
        """The token counts of a block of texts."""
        documents = [self.frequencies(t or "") for t in texts]
        distinct = set().union(*(f for f, _ in documents)) if documents else set()
        if len(self._memo) + len(distinct) > self._entries:
            self._memo = {}
        table = self._memo
        long = {}
        for p in distinct:
            if p not in table:
                (table if len(p) <= self._chars else long)[p] = self.pieces(p)
        if long:
            table = {**{p: table[p] for p in distinct if p in table}, **long}
        return [sum(map(int.__mul__, map(table.__getitem__, f), f.values())) + added for f, added in documents]


def token_counts(df: DataFrame, tokenizer_path: str | Callable[[], str], id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``df``: id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer_path`` is the file's path, or a function that gives it on the executor.
    """
    schema = df.select(id_col).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or PieceCounter(tokenizer_path() if callable(tokenizer_path) else tokenizer_path)
            ids, texts = batch.column(0), batch.column(1)
            import pyarrow.compute as pc

            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            counts: list[int] = []
            block: list[str | None] = []
            held = 0
            for text, size in zip(texts, sizes.to_pylist(), strict=True):
                block.append(text.as_py())
                held += size
                if held >= block_bytes:
                    counts += counter.count(block)
                    block, held = [], 0
            counts += counter.count(block)
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, sizes, n, pc.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, df[text_col].cast("string").alias("text")).mapInArrow(run, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")
