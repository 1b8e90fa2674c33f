import glob

import numpy as np
import pytest

from corpusmill.llm.token_shards import permuted, read_slots, records, vocabulary, write_shards


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097, 65_537])
def test_slots_are_a_bijection(n):
    out = permuted(np.arange(n), n, key=5)
    assert sorted(out.tolist()) == list(range(n))
    assert n < 1000 or (np.abs(np.diff(out)) > 1).mean() > 0.9
    assert n < 17 or out.tolist() != permuted(np.arange(n), n, key=6).tolist()


def stored(spark, shards):
    """Documents' tokens as put together from the records, by document and its first token there."""
    held = {r["slot"]: np.frombuffer(bytes(r["tokens"]), "<u2") for r in read_slots(spark, shards).collect()}
    pieces = {}
    for m in shards.manifest.collect():
        for d in m["docs"]:
            pieces.setdefault(d["doc"], []).append((d["from"], held[m["slot"]][d["at"] : d["at"] + d["n"]].tolist()))
    assert sorted(held) == list(range(shards.n_sequences))
    return pieces


def test_round_trip(spark, documents, tmp_path):
    ranks = vocabulary()
    back = {v: k for k, v in ranks.items()}
    texts = {i: " ".join(f"w{(i * j) % 57} ünd" for j in range(i * 7 % 400)) for i in range(60)}
    shards = write_shards(documents(texts.items(), 3), str(tmp_path / "s"), sequence=64, shard=10, key=3)
    for doc, parts in stored(spark, shards).items():
        tokens = [t for _, p in sorted(parts) for t in p]
        assert tokens.pop() == max(ranks.values()) + 1
        assert b"".join(back[t] for t in tokens).decode() == texts[doc]
    files = sorted(glob.glob(f"{shards.path}/part-*"))
    assert len(files) == -(-shards.n_sequences // 10)
    for m in shards.manifest.collect():  # each record where the manifest says
        with open(files[m["shard"]], "rb") as f:
            f.seek(m["offset"])
            assert int.from_bytes(f.read(8), "little") == m["slot"]
    tail = read_slots(spark, shards, 13).collect()
    assert sorted(r["slot"] for r in tail) == list(range(13, shards.n_sequences))
    assert read_slots(spark, shards, shards.n_sequences).count() == 0


def test_all_kinds_of_rows(spark, hostile, nothing, tmp_path):
    shards = write_shards(hostile, str(tmp_path / "s"), sequence=32, shard=100)
    pieces = stored(spark, shards)
    assert set(pieces) == {1, 3, 4, 5, 7, 8, None}  # a null text is left out, an empty one is its end
    assert len([p for p in pieces[7] if p[0] == 0]) == 3
    assert pieces[3] == [(0, [50256])]
    empty = write_shards(nothing, str(tmp_path / "e"))
    assert (empty.n_sequences, empty.manifest.count(), read_slots(spark, empty).count()) == (0, 0, 0)


def test_a_record_out_of_step_is_an_error():
    with pytest.raises(ValueError, match="no record"):
        list(records(b"x" * 40, 20))
