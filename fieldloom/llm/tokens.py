"""Token ids of texts by a public tokenizer file. The file's path is a parameter; workers open it once each.

On a cluster the path must be readable on every worker, or be shipped with the job (``--files``).

Defined results: an empty text has no ids; texts of any length are encoded whole, in time that grows with their length; text
that looks like a special token is text. The library's split gives up on runs of about a million blanks, so runs of
``LONG_RUN`` or more are cut out before it as it would cut them: all but the last blank is a piece, or all at the text's end.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import tiktoken

#: The pattern that splits text before the merges of byte-level rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def rank_encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


LONG_RUN = 100_000
#: What the split pattern takes for blank: Unicode's White_Space.
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_BLANKS = re.compile(f"{BLANK}{{{LONG_RUN},}}")


def token_ids(encoding: tiktoken.Encoding, text: str, blanks: re.Pattern = _LONG_BLANKS) -> np.ndarray:
    """Ids of a whole text, as uint32."""
    parts, done = [], 0
    for run in blanks.finditer(text) if len(text) >= LONG_RUN or blanks is not _LONG_BLANKS else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        if end > run.start():
            parts += [encoding.encode_to_numpy(text[done : run.start()], disallowed_special=()), np.array(encoding._encode_single_piece(text[run.start() : end]), dtype=np.uint32)]
            done = end
    parts.append(encoding.encode_to_numpy(text[done:], disallowed_special=()))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]
