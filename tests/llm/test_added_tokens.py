import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import tokens

PATH = P.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", " the", "é", "<|", "|>", "endoftext"]), max_size=12).map("".join), min_size=1, max_size=4))
def test_added_tokens_as_an_unmodified_library(texts):
    ids, at = tokens.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == [LIBRARY.encode(x, add_special_tokens=False).ids for x in texts]


def test_an_added_token_has_one_id():
    ids, _ = tokens.encoder(PATH).encode(pa.array(["a<|endoftext|>b"]))
    assert ids.tolist() == [64, 50256, 65]
