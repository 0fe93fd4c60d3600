"""Whole-document encoding with a public tokenizer, fast for natural text.

The word tokenizer drops white space, lower-cases, and never lets a token or a
normalization step reach across white space or from an ASCII letter or digit to
ASCII punctuation. So a document's ids are those of its runs between such
places, one after another, and each distinct run needs encoding only once. That
follows from the tokenizer's own description, which is compared with the rules of
RULES; any other tokenizer gets every document as a whole."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from voxmill.llm.common import flat_ranges, utf8_buffer

#: Distinct runs, and bytes of them, that a worker remembers; words encoded as one text.
REMEMBER, CHARACTERS, TOGETHER = 600_000, 16_000_000, 200
#: Kinds of bytes: 1 ASCII letters and digits, 2 ASCII punctuation that stands in
#: no special token or contraction, 3 white space, 4 A-Z (added to 1).
KIND = np.zeros(256, np.uint8)
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
KIND[[ord(c) for c in "'<|>"]] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
KIND[[32, *range(9, 14)]] = 3


#: The description of a tokenizer that encodes run by run.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def goes_by_runs(path: str) -> bool:
    """Whether a tokenizer's description is that of RULES, with whole words that end in
    </w> and added tokens like <|this|> alone."""
    with open(path) as file:
        about = json.load(file)
    model = about["model"]
    return (
        all(about.get(k) == v for k, v in RULES.items()) and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>"
        and model.get("unk_token") is None and not model.get("dropout") and about.get("truncation") is None
        and all(t["content"].startswith("<|") and t["content"].endswith("|>") for t in about.get("added_tokens", []))
    )


def run_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where runs begin; a run's white space stands at its end."""
    kind = KIND[raw]
    if len(raw) > 1:
        # two-byte Latin letters count as letters on the left of punctuation
        latin = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        kind[1:][latin] = 1
    first = np.zeros(len(raw) + 1, bool)
    if len(raw):
        a, b = kind[:-1], kind[1:]
        first[1:-1] = ((a == 3) & (b != 3)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1) & (raw[1:] < 0x80))
    first[bounds] = True
    return np.flatnonzero(first)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, but for letters that a combining mark may follow."""
    upper = (raw >= 65) & (raw <= 90)
    upper[:-1] &= raw[1:] < 0x80
    return raw + (upper.view(np.uint8) << 5)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes whole documents, run by run where the tokenizer allows it. spans: also
    keep the code points that each token covers."""

    def __init__(self, path: str, spans: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spans = Tokenizer.from_file(path), spans
        self.by_runs = goes_by_runs(path)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.rel = np.zeros((0, 2), np.int32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        found = encode(texts, add_special_tokens=False)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        rel = np.array([p for x in found for ab in x.offsets for p in ab] if self.spans else [], np.int32).reshape(-1, 2)
        return np.array([i for x in found for i in x.ids], np.uint32), sizes, rel

    def _learn(self, runs: list[str]) -> None:
        """A run of letters alone is one word of the tokenizer, with an end mark
        on its last token; so many of them can be encoded as one text."""
        words = [x for x in runs if x.isalpha()]
        others = [x for x in runs if not x.isalpha()]
        joined = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        ids, sizes, rel = self._encoded([" ".join(x) for x in joined])
        ends = np.flatnonzero(self.word_end[ids])
        if len(ends) != len(words):
            words, others = [], runs
            ids, sizes, rel = ids[:0], sizes[:0], rel[:0]
        else:
            if self.spans:
                at = np.concatenate([[0], np.cumsum(sizes)])
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                base = np.concatenate([np.cumsum(x + 1) - x - 1 for x in (lengths[i : i + TOGETHER] for i in range(0, len(words), TOGETHER))]) if words else lengths
                rel = rel - np.repeat(base, np.diff(ends, prepend=-1))[:, None]
            sizes = np.diff(ends, prepend=-1)
        more, counts, spans = self._encoded(others)
        sizes = np.concatenate([sizes, counts])
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.ids = np.concatenate([self.ids, ids, more])
        self.rel = np.concatenate([self.rel, rel, spans])
        self.known = pa.concat_arrays([self.known, pa.array(words + others, pa.large_string())])

    def encode(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """ids: of all texts; bounds: of each text's ids; with spans also lo and
        hi, each token's code points in its own text."""
        raw, bounds = utf8_buffer(texts)
        if not self.by_runs:
            ids, sizes, rel = self._encoded(pc.fill_null(texts.cast(pa.large_string()), "").to_pylist())
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            spans = {"lo": rel[:, 0], "hi": rel[:, 1], "points": points, "raw": raw, "text_bounds": bounds} if self.spans else {}
            return {"ids": ids, "bounds": np.concatenate([[0], np.cumsum(sizes)]), **spans}
        if len(self.known) > REMEMBER or self.known.nbytes > CHARACTERS:
            self._forget()
        starts = run_starts(raw, bounds)
        solid = KIND[raw] != 3
        upto = np.concatenate([[0], np.cumsum(solid)])[starts]
        coded = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(upto), pa.py_buffer(lowered(raw)[solid])).dictionary_encode()
        known = pc.index_in(coded.dictionary, self.known)
        if known.null_count:
            self._learn(coded.dictionary.filter(known.is_null()).to_pylist())
            known = pc.index_in(coded.dictionary, self.known)
        index = known.to_numpy()[coded.indices.to_numpy()]
        start, size, ids, rel = self.start[index], self.size[index], self.ids, self.rel
        sizes = size
        at = flat_ranges(start, sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = {"ids": ids[at], "bounds": upto[np.searchsorted(starts, bounds)]}
        if self.spans:
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            own = np.repeat(np.arange(len(bounds) - 1), np.diff(out["bounds"]))
            base = np.repeat(points[starts[:-1]], sizes) - points[bounds[:-1]][own]
            out |= {"lo": base + rel[at, 0], "hi": base + rel[at, 1], "points": points, "raw": raw, "text_bounds": bounds}
        return out
