"""Ids of texts cut into pieces against those of whole texts, and how many pieces are encoded at once."""

import random

import numpy as np
import pyarrow as pa
import tokenizers

from accordant.llm import tokens
from accordant.llm.queries import tokenizer_file


def test_pieces_give_the_ids_of_whole_texts_few_at_once():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéüßñ") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", ".", "'s", "$$$", "\nnew", "12"])
    texts = [" ".join(word() for _ in range(rng.randint(1, 400))) for _ in range(30)] + ["", None, "  two  spaces ", "line \n end\n", "the", " the", "the the"]
    encoder = tokens.Encoder(tokenizer_file())
    plain, sent, ids_of = tokenizers.Tokenizer.from_file(tokenizer_file()), [], encoder._ids
    encoder._ids = lambda many: sent.extend(many) or ids_of(many)
    got = encoder.encode(pa.array(texts)) + encoder.encode(pa.array(texts[::-1]))
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts + texts[::-1]]
    assert [x.tolist() for x in got] == want and all(x.dtype == np.uint32 for x in got)
    assert max(t.count(" ") for t in sent) <= 500
