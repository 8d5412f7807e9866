"""Public tokenizer files, opened once a Python process. ``vocab`` names a file of the public_tokenizers folder or is a path."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable

#: Characters on which both byte-BPE libraries split alike whatever their Unicode version: ASCII and Latin letters.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-ɏ‐-‧€]*")


def vocab_path(name: str) -> str:
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: A run of white space (Unicode's White_Space) too long for the fast library's matcher, which keeps a step for each character.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


@functools.cache
def rank_bpe(vocab: str) -> Callable[[str], list[int]]:
    """text -> ids of the rank file ``<vocab>.tiktoken``.

    A run of 10,000 white-space characters or more is one piece of the vocabulary's pattern (but for its last character, where a
    word follows), so it is cut out and merged as that piece; the matcher never sees it.
    """
    import public_tokenizers
    import tiktoken

    with open(vocab_path(f"{vocab}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding(vocab, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if len(text) < 10_000 or not _BLANKS.search(text):
            return made.encode_ordinary(text)
        ids, at = [], 0
        for run in _BLANKS.finditer(text):
            stop = run.end() if run.end() == len(text) else run.end() - 1
            ids += made.encode_ordinary(text[at : run.start()])
            ids += made._encode_single_piece(text[run.start() : stop])
            at = stop
        return ids + made.encode_ordinary(text[at:])

    return encode


@functools.cache
def json_bpe(vocab: str) -> Callable[[str], list[int]]:
    """text -> ids of ``<vocab>.json``, special tokens' strings taken as ordinary text, as the vocabulary's description asks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocab_path(f"{vocab}.json"))
    full.encode_special_tokens = True
    return lambda text: list(full.encode(text, add_special_tokens=False).ids)


@functools.cache
def byte_bpe(vocab: str = "byte_bpe_50k") -> Callable[[str], list[int]]:
    """text -> ids of ``<vocab>.json``.

    Most texts go through the same vocabulary's rank file, whose library is about six times as fast; a text with characters
    on which the two libraries' tables might differ goes through the json file itself. Each file is opened when a text needs it,
    so a worker that meets plain texts alone holds one vocabulary.
    """

    def encode(text: str) -> list[int]:
        return (rank_bpe if _PLAIN.fullmatch(text) else json_bpe)(vocab)(text)

    return encode
