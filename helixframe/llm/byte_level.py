"""Ids of a byte-level vocabulary, as `tokenizers` gives them for its JSON form, from its ranks by `tiktoken`."""

import base64
import re
from functools import lru_cache

import numpy as np

END_OF_TEXT = "<|endoftext|>"

# Fixed: the characters that the vocabulary's pattern takes for white space (Unicode White_Space).
BLANK = r"\t-\r \x85\xa0  -     　"
#: Runs of white space from this length on go around the pattern's matcher, whose stack ends at about 1,000,000.
LONG_RUN = 50_000
LONG_BLANK = re.compile(f"[{BLANK}]{{{LONG_RUN},}}")


@lru_cache(maxsize=2)
def ranks(vocabulary: str | None) -> dict[bytes, int]:
    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(vocabulary: str | None):
    import public_tokenizers
    import tiktoken

    known = ranks(vocabulary)
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={END_OF_TEXT: len(known)})


def token_ids(text: str, vocabulary: str | None = None, special: bool = True) -> np.ndarray:
    """The ids (uint32) of a text of any length. special: END_OF_TEXT in it is one id, else plain text.

    A run of white space is one piece for the merges, but for its last character where text follows,
    which begins the next piece. So a very long run can be cut out and merged on its own.
    """
    own = encoder(vocabulary)
    allowed = {END_OF_TEXT} if special else set()
    plain = lambda t: own.encode_to_numpy(t, allowed_special=allowed, disallowed_special=())
    if len(text) < LONG_RUN:
        return plain(text)
    parts, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts += [plain(text[at : run.start()]), np.array(own._encode_single_piece(text[run.start() : end]), dtype=np.uint32)]
        at = end
    return np.concatenate([*parts, plain(text[at:])])


@lru_cache(maxsize=2)
def token_bytes(vocabulary: str | None = None) -> list[bytes]:
    """The bytes of each id, END_OF_TEXT last."""
    known = ranks(vocabulary)
    out = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = token
    return [*out, END_OF_TEXT.encode()]
