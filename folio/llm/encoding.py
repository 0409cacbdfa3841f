"""Token ids of texts by a byte-level pair vocabulary of the ``tokenizers`` library.

The library cuts a text into pieces before it merges, and a space between two other
characters always begins a new piece. So a text may be cut at such spaces, and each
distinct part encoded once: corpora repeat their words. A text in which a space stands
beside other white space, or which holds a special token's string, is encoded whole.

For the same reason parts that begin with such a space may be put in a row and given to
the library together: an id whose string begins with a space begins the next part.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PARTS_KEPT = 600_000  # distinct parts remembered within a task
SLICE = 4 << 20  # bytes of text that callers hand over at once
JOINED = 1_000  # parts given to the library as one text

SPACE_LETTER = "\u0120"  # fixed value: how byte-level vocabularies write a space

_SPACE = r"\x{1c}-\x{1f}\t\n\x{0b}\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BESIDE_SPACE = f" [{_SPACE}]|[{_SPACE}] "


class Encoder:
    """Made inside a task. ``path`` names the tokenizer's file on every machine; ``kept`` parts are
    remembered. When they are more, all are forgotten, or with ``often`` all but the most used half."""

    def __init__(self, path: str, kept: int = PARTS_KEPT, often: bool = False):
        self.kept, self.often = kept, often
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        self.byte_level = (
            type(cut).__name__ == "ByteLevel"
            and not cut.add_prefix_space
            and self.tokenizer.normalizer is None
            and not any(" " in content for content in self.special)
        )
        vocabulary = self.tokenizer.get_vocab()
        self.begins_part = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins_part[[i for word, i in vocabulary.items() if word.startswith(SPACE_LETTER)]] = True
        self._forget()

    def _forget(self) -> None:
        """Ids of parts lie in a row; a part's place is that of its start and length. A part
        that begins with a space is kept without it; a space alone is there from the start."""
        self.ids, self.lengths = self._whole([" "])
        self.starts = np.zeros(1, np.int64)
        self.opening: dict[str, int] = {}
        self.later: dict[str, int] = {"": 0}
        self.uses = np.zeros(1, np.int64)

    def _forget_rare(self) -> None:
        """Forget all but the ``kept // 2`` parts used most; older uses count less each time."""
        chosen = np.sort(np.append(np.argsort(-self.uses[1:], kind="stable")[: self.kept // 2] + 1, 0))
        place = np.full(len(self.uses), -1)
        place[chosen] = np.arange(len(chosen))
        known = pa.LargeListArray.from_arrays(np.concatenate([self.starts, [len(self.ids)]]), self.ids)
        self.ids, self.lengths = np.array(known.take(pa.array(chosen)).values), self.lengths[chosen]
        self.starts, self.uses = np.cumsum(self.lengths) - self.lengths, self.uses[chosen] // 2
        place = place.tolist()
        self.opening, self.later = ({part: place[at] for part, at in d.items() if place[at] >= 0} for d in (self.opening, self.later))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _after_spaces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that follow a space each; none is empty."""
        ids, lengths = [], []
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            found = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids
            found = np.array(found, np.uint32)
            first = np.flatnonzero(self.begins_part[found])
            if len(first) == len(some) and not first[0]:
                n = np.diff(first, append=len(found))
            else:  # a vocabulary that lacks bytes
                found, n = self._whole([" " + part for part in some])
            ids.append(found)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _places(self, parts: list[str], place: dict[str, int], encode: Callable) -> np.ndarray:
        """Places of distinct parts' ids; parts not seen before are encoded."""
        found = np.fromiter(map(place.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0)
        if len(new):
            some = [parts[k] for k in new.tolist()]
            ids, lengths = encode(some)
            found[new] = np.arange(len(self.lengths), len(self.lengths) + len(some))
            place.update(zip(some, found[new].tolist()))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.ids = np.concatenate([self.ids, ids])
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) in a row, ``end_id`` after each; the number of ids of each text."""
        if not self.byte_level:
            ids, lengths = self._whole(texts.to_pylist())
            return np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
        if len(self.lengths) > self.kept:
            self._forget_rare() if self.often else self._forget()
        odd = np.asarray(pc.match_substring_regex(texts, _BESIDE_SPACE))
        for content in self.special:
            odd |= np.asarray(pc.match_substring(texts, content))
        plain_ids, plain_lengths = self._encode_parts(texts.filter(pa.array(~odd)))
        odd_ids, odd_lengths = self._whole(texts.filter(pa.array(odd)).to_pylist())

        lengths = np.empty(len(texts), np.int64)
        lengths[~odd], lengths[odd] = plain_lengths, odd_lengths
        out = np.full(int(lengths.sum()) + len(texts), end_id, np.uint32)
        is_id = np.ones(len(out), bool)
        is_id[np.cumsum(lengths + 1) - 1] = False
        if not len(odd_ids):
            out[is_id] = plain_ids
            return out, lengths + 1
        of_odd = np.zeros(len(out), bool)
        of_odd[is_id] = np.repeat(odd, lengths)
        out[of_odd] = odd_ids
        out[is_id & ~of_odd] = plain_ids
        return out, lengths + 1

    def _encode_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, dtype=np.int64)
        values = coded.dictionary.to_numpy(zero_copy_only=False)
        first = offsets[:-1]
        opening = np.unique(codes[first])
        rest = np.ones(len(codes), bool)
        rest[first] = False
        times = np.bincount(codes[rest], minlength=len(values))
        later = np.flatnonzero(times)
        of_opening, of_later = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        of_opening[opening] = self._places(values[opening].tolist(), self.opening, self._whole)
        of_later[later] = self._places(values[later].tolist(), self.later, self._after_spaces)
        if self.often:
            self.uses = np.concatenate([self.uses, np.zeros(len(self.lengths) - len(self.uses), np.int64)])
            self.uses[of_later[later]] += times[later]
            self.uses[of_opening[opening]] += 1
        places = of_later[codes]
        places[first] = of_opening[codes[first]]

        known = pa.LargeListArray.from_arrays(np.concatenate([self.starts, [len(self.ids)]]), self.ids)
        found = known.take(pa.array(places))
        ends = np.asarray(found.offsets)
        return np.asarray(found.values), np.diff(ends[offsets])


def kept_encoder(held: dict, path: str, kept: int = PARTS_KEPT, often: bool = False) -> Encoder:
    """The encoder in ``held``, made if it is not there. The value of a broadcast stays in a
    Python worker, so its tasks read the vocabulary once and share the parts remembered."""
    if "encoder" not in held:
        held["encoder"] = Encoder(path, kept, often)
    return held["encoder"]
