"""Plain versions of operators, for tests of the pipeline."""

from collections import Counter

from test_dedup import brute_exact, brute_near  # noqa: F401
from tokenizers import Tokenizer

from tessera.llm.tokens import tokenizer_path


def expected_tokens(docs):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    out = Counter()
    for i, text in docs:
        out[repr(i)] += len(library.encode(text or "", add_special_tokens=False).ids) + 1
    return dict(out)
