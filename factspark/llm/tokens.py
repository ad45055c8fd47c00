"""Token ids of whole texts, as little-endian bytes, inside Arrow tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

#: Words kept with their ids per Python worker (about 200 bytes each); then it starts anew.
CACHED_WORDS = 800_000
#: Characters handed to the tokenizer at once, to bound its memory.
CHUNK = 1_000_000

#: New words of letters are encoded as lines of so many.
LINE_WORDS = 100

PROBES = ["a b", " A  b\tc,d", "it's 'll 12 3\n\n(x) é́ z", "un-do\x0bre.do\f!! ?", "QuItE Ünlike ÀB"]
#: A stop after a word of ASCII letters.
STOPS = ".,;:!?"
#: What every special token of the known tokenizers begins with.
SPECIAL = "<|"


def laws(tokenizer) -> tuple[bool, bool, bool]:
    """What the ids of a text do not depend on, by probes: white space between words, the
    case of ASCII letters, whether a stop stands apart from the word before it."""
    def ids(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    spaces = all(ids(p) == [i for w in p.encode().split() for i in ids(w.decode())] for p in PROBES)
    case = all(ids(p) == ids(p.encode().lower().decode()) for p in PROBES)
    stops = all(ids(f"{w}{c}") == ids(w) + ids(c) for w in ("a", "word", "Thing") for c in STOPS)
    return spaces, case, stops


def word_ends(tokenizer):
    """For each id whether it ends a word, or None if the model does not mark that."""
    import json

    import numpy as np

    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    if not suffix:
        return None
    flags = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        flags[i] = token.endswith(suffix)
    return flags


def encoder(path: str, width: int, specials_as_text: bool = False) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts (null: empty) to their ids, ``width`` bytes each.

    Special tokens are not added; their strings in a text become their ids, or ordinary ids
    with ``specials_as_text``.  Where the tokenizer drops white space and never looks
    across it (tested on probes), each distinct word is encoded once per worker and a text
    is the concatenation of its words; an ASCII word and the stop after it, and ASCII texts that differ in
    case only, share their encoding if the tokenizer treats them so.  Texts with the beginning of
    a special token, and all texts of other tokenizers, are encoded whole.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    # Functions travel by value, so what a worker keeps between tasks hangs on a real module.
    kept = sys.modules["tokenizers"].__dict__.setdefault("_encoders", {})
    key = (path, width, specials_as_text)
    if key in kept:
        return kept[key]
    import numpy as np

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = specials_as_text
    dtype = f"<u{width}"
    if tokenizer.get_vocab_size() > 1 << (8 * width):
        raise ValueError(f"ids of {path} do not fit {width} bytes")

    def packed(ids) -> bytes:
        return np.asarray(ids, dtype=dtype).tobytes()

    def whole(texts):
        out = []
        for part in chunks(texts, CHUNK):
            out += [packed(e.ids) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    spaces, case, stops = laws(tokenizer)
    last = word_ends(tokenizer)
    cache: dict[str, bytes] = {"": b""}

    def learn(words: list[str]):
        """Encode new words: a stop apart after ASCII letters, words of letters by lines, others one by one."""
        stopped = [w for w in words if stops and w[-1:] in STOPS and w[:-1].isascii() and w[:-1].isalpha()]
        apart = set(stopped)
        plain = list({x for w in stopped for x in (w[:-1], w[-1:]) if x not in cache} | {w for w in words if w not in apart})
        # a letter whose small form is more than a letter takes marks along, which may be split off
        letters = [w for w in plain if last is not None and w.isalpha() and w.lower().isalpha()]
        lines = [letters[i : i + LINE_WORDS] for i in range(0, len(letters), LINE_WORDS)]
        for line, e in zip(lines, tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(e.ids, dtype)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(line):
                body, cuts = ids.tobytes(), [0, *(ends * width).tolist()]
                cache.update(zip(line, map(body.__getitem__, map(slice, cuts, cuts[1:]))))
        rest = [w for w in plain if w not in cache]
        for part in chunks(rest, CHUNK):
            cache.update((w, packed(e.ids)) for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        cache.update((w, cache[w[:-1]] + cache[w[-1:]]) for w in stopped)

    def by_words(texts):
        """Distinct words of a chunk are found by Arrow; a text's ids are gathered from theirs."""
        import pyarrow as pa
        import pyarrow.compute as pc

        out = []
        for part in chunks(texts, CHUNK):
            # what may hold a special token, in any case, is left to the tokenizer
            odd = {i for i, text in enumerate(part) if SPECIAL in text}
            given = ["" if i in odd else text.lower() if case and text.isascii() else text for i, text in enumerate(part)]
            split = pc.ascii_split_whitespace(pa.array(given, pa.large_string()))
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w not in cache]
            if len(cache) + len(new) > CACHED_WORDS:
                cache.clear()
                cache[""] = b""
                new = words
            learn(new)
            bodies = [cache[w] for w in words]
            known = np.frombuffer(b"".join(bodies), dtype)
            sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // width
            starts = np.cumsum(sizes) - sizes
            codes = coded.indices.to_numpy()
            n = sizes[codes]
            upto = np.concatenate([[0], np.cumsum(n)])
            ids = known[np.repeat(starts[codes] - upto[:-1], n) + np.arange(upto[-1])].tobytes() if len(known) else b""
            cuts = (upto[split.offsets.to_numpy()] * width).tolist()
            found = list(map(ids.__getitem__, map(slice, cuts, cuts[1:])))
            for i, body in zip(sorted(odd), whole([part[i] for i in sorted(odd)])):
                found[i] = body
            out += found
        return out

    step = by_words if spaces else whole
    kept[key] = lambda texts: step([t or "" for t in texts])
    return kept[key]


def chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    """Consecutive lists of at most ``most`` characters, or of one longer text."""
    part, size = [], 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part
