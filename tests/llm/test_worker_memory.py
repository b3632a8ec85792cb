"""What a worker holds between its tasks and while it learns: executors' memory is shared with it."""

import public_tokenizers as P
import pyarrow as pa

from quern.llm import arrow, tokens

PATH = P.path("byte_bpe_50k.json")


def test_caches_go_when_another_operator_begins(spark):
    """A task that encodes leaves its vocabulary to the next one that does, and to no other; the rows stay the same."""

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(tokens._encoders)])], ["n"])

    def first(batches):
        for b in batches:
            tokens.encoder(PATH).encode(pa.array(["a b c"]))
            yield pa.RecordBatch.from_arrays([pa.array([1])], ["n"])

    one = spark.range(1).coalesce(1)
    once = lambda run, **how: [r.n for r in one.mapInArrow(arrow.tidied(run, **how), "n long").collect()]
    assert once(first, cached=True) == [1]
    assert once(look) == [0]
    kept = arrow.worker_cache()
    kept["ids"] = [1]
    assert list(arrow.tidied(iter, cached=True)([7])) == [7] and kept
    assert list(arrow.tidied(iter)([7])) == [7] and not kept
    arrow._kept.remove(kept)


def test_many_new_pieces_are_learned_in_parts(monkeypatch):
    """The ids of new words are Python lists until they are kept, so only so many are learned at once."""
    enc, sizes = tokens.Encoder(PATH), []
    keep = enc._append
    monkeypatch.setattr(enc, "_append", lambda new, *rest: (sizes.append(len(new)), keep(new, *rest)))
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{'q' * (i // 17576)}" for i in range(50_000)]
    texts = [" ".join(words[:30_000]), " ".join(words[30_000:]) + " 12;34 ", "é, ä. !"]
    ids, at = enc.encode(pa.array(texts))
    assert max(sizes) <= 20_000
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == enc.model.encode(x, add_special_tokens=False).ids
