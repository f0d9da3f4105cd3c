"""Token ids of whole texts, put together from words."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from quarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "Plain words, and. MORE: words! don't it's, O'Neil. a.b.c 1.5% x2. #tag$5&6*7",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> end.<|endoftext|>", "H̱ ẖ T̈. J̌, Á.", "É. È, ÿ; Straße. ÄÖÜ!",
    "İstanbul. ΣΑΣ. K. ｆｕｌｌ.", "tab\tline\nreturn\r\x0bfeed\x0c gap　x", "一二三。four. 5五.", "a|b. c|| ''' word.'s 'S. 'LL", "\U0001f600. è.e", "Word. word, WORD",
]


def test_ids_are_those_of_the_whole_text():
    texts = ODD + [a + b for a in ODD for b in ODD]
    every = pa.array(texts, pa.string())
    own = Tokenizer.from_file(PATH)
    for at in (0, 3, 11):
        found = [np.frombuffer(x, "<u4").tolist() for x in packing.document_ids(every.slice(at, 100), PATH, 2)]
        assert found == [[*own.encode(t, add_special_tokens=False).ids, 2] for t in texts[at : at + 100]]


def test_a_word_is_encoded_once_whatever_its_case_and_the_signs_behind():
    known = packing.process_cache("words_" + PATH, lambda: packing._Words(PATH))
    known.clear()
    packing.document_ids(pa.array(["Zebra. zebra, ZEBRA", "zebra!"]), PATH, 2)
    assert set(known.number) == {"zebra", ".", ",", "!"}
