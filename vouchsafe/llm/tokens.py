"""Token ids of whole texts, exactly as the tokenizer gives them.

The vocabulary's pre-tokenizer drops white space and never looks across it, so the ids of a
text are those of its white-space-separated chunks, one after the other. The chunks of many texts are
brought down to the different ones, and those to a word and the marks after it. Words are looked up in a
bounded table first; unseen ones are encoded together. ``tests/llm`` compares with ``Tokenizer.encode``
of whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

VOCABULARY = "word_bpe_49k.json"
#: Bytes that the known words of one Python worker may take, in two tables of half as much. When the newer one is
#: full it becomes the older, from which words that are met again move over, and the one before that goes.
TABLE_BYTES = 128 << 20
#: What an entry takes besides the bytes of its word and ids: two objects and a place in a dictionary.
_ENTRY_BYTES = 190
#: Chunks that are brought down to the different ones at once.
_SLICE = 2_097_152
#: Words and chunks up to this many bytes are kept; longer ones are encoded each time.
TABLE_CHUNK = 64
# Letters that normalisation only lower-cases, and marks that it leaves alone: each run is one pre-token.
_PARTS = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]{1,32})(?P<tail>[!-&(-/:;=?@\[-`{}~]{0,16})$"
_BATCH = 2000
#: Bytes of text that a task brings down to different chunks at once.
TEXT_BYTES = 4 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class Encoder:
    """Encodes UTF-8 texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        # The same model behind a cheaper front, for chunks that are one plain word, written in the model's characters
        # for bytes: each word ends with a token that can end a word, and no other token can.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        mark = self.library.encode("\x00", add_special_tokens=False).ids
        assert len(mark) == 1
        self.mark = mark[0]
        self.table: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.filled = 0  # bytes in the newer table, estimated from above

    def _whole(self, chunk: bytes) -> bytes:
        ids = self.library.encode(chunk.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of many plain words, encoded in one text."""
        out = []
        for i in range(0, len(words), _BATCH):
            part = words[i : i + _BATCH]
            text = b" ".join(part).decode().translate(self.letters)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            assert len(ends) == len(part) and ends[-1] == 4 * len(ids)
            data, ends = ids.tobytes(), ends.tolist()
            out += [data[s:e] for s, e in zip([0, *ends], ends)]
        return out

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of many chunks, encoded in one text with a mark between them that is a token by itself."""
        out = []
        for i in range(0, len(chunks), _BATCH):
            part = chunks[i : i + _BATCH]
            text = b" \x00 ".join(part).decode()
            ids = np.array(
                self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"
            )
            marks = np.flatnonzero(ids == self.mark)
            assert len(marks) == len(part) - 1
            data = ids.tobytes()
            starts = [0, *(4 * (marks + 1)).tolist()]
            ends = [*(4 * marks).tolist(), len(data)]
            out += [data[s:e] for s, e in zip(starts, ends)]
        return out

    def _known(self, keys: list[bytes], learn: Callable[[list[bytes]], list[bytes]]) -> pa.Array:
        """The ids of different keys; unseen ones are learnt."""
        table, older = self.table, self.older
        found = [table.get(key) for key in keys]
        unseen = []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            key = keys[i]
            ids = found[i] = older.get(key)
            if ids is None:
                unseen.append(i)
            else:
                table[key] = ids
                self.filled += _ENTRY_BYTES + len(key) + len(ids)
        new = [keys[i] for i in unseen]
        for i, key, ids in zip(unseen, new, learn(new)):
            found[i] = table[key] = ids
            self.filled += _ENTRY_BYTES + len(key) + len(ids)
        return pa.array(found, pa.large_binary())

    def _of_others(self, chunks: list[bytes]) -> pa.Array:
        """The ids of different chunks that are no plain words."""
        alone = [len(c) > TABLE_CHUNK or b"\x00" in c or b"<|" in c for c in chunks]
        kept = iter(self._known([c for c, a in zip(chunks, alone) if not a], self._learn).to_pylist())
        return pa.array([self._whole(c) if a else next(kept) for c, a in zip(chunks, alone)], pa.large_binary())

    def _of_chunks(self, chunks: pa.Array) -> pa.Array:
        """The ids of each chunk."""
        if self.filled > TABLE_BYTES // 2:
            self.older, self.table, self.filled = self.table, {}, 0
        coded = pc.dictionary_encode(chunks)
        parts = pc.extract_regex(coded.dictionary, _PARTS)
        plain = pc.is_valid(parts)
        word, tail = (pc.dictionary_encode(x) for x in parts.filter(plain).flatten())
        words = pc.dictionary_encode(pc.utf8_lower(word.dictionary))
        ids = self._known(words.dictionary.cast(pa.large_binary()).to_pylist(), self._learn_words)
        ids = ids.take(words.indices).take(word.indices)
        tails = self._known(tail.dictionary.cast(pa.large_binary()).to_pylist(), self._learn).take(tail.indices)
        others = self._of_others(coded.dictionary.filter(pc.invert(plain)).cast(pa.large_binary()).to_pylist())
        found = pa.concat_arrays([pc.binary_join_element_wise(ids, tails, pa.scalar(b"", pa.large_binary())), others])
        # those of plain words come first, then the others: back to the order of the different chunks
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1, mask.sum() + np.cumsum(~mask) - 1)
        return found.take(pa.array(place).take(coded.indices))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Their chunks are looked up in slices, so many or giant texts keep memory bounded."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        chunks = split.flatten()
        data, sizes = [], [np.zeros(1, np.int64)]
        for start in range(0, len(chunks), _SLICE):
            ids = self._of_chunks(chunks.slice(start, _SLICE))
            _, offsets, content = ids.buffers()
            at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
            data.append(content[at[0] : at[-1]].to_pybytes() if content is not None else b"")
            sizes.append(np.diff(at))
        all_ids, ends = b"".join(data), np.cumsum(np.concatenate(sizes))
        at = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [all_ids[s:e] for s, e in zip(at, at[1:])]

    def forget(self) -> None:
        """Give the tables' memory back."""
        self.table, self.older, self.filled = {}, {}, 0


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@contextmanager
def task_encoder(path: str) -> Iterator[Encoder]:
    """The worker's encoder, whose tables last as long as a task: workers that wait for others hold none."""
    known = _encoder(path)
    try:
        yield known
    finally:
        known.forget()
