"""The lookup table and the placement of keys against a plain statement of both."""

import hashlib
from itertools import cycle

import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
from tracemark.llm import queries, sharding  # noqa: E402


def _by_turns(names, size):
    """slot -> name: in turns, each name takes the first free slot of its own order."""

    def order(name):
        digest = hashlib.md5(name.encode()).hexdigest()
        first, step = int(digest[:16], 16) % size, int(digest[16:], 16) % (size - 1) + 1
        return ((first + j * step) % size for j in range(size))

    wanted, free, taken = {n: order(n) for n in names}, set(range(size)), {}
    for name in cycle(names):
        if not free:
            return taken
        slot = next(s for s in wanted[name] if s in free)
        free.remove(slot)
        taken[slot] = name


@pytest.mark.parametrize("n, size", [(1, 7), (7, 7), (5, 503), (64, sharding.TABLE_SIZE)])
def test_table(n, size):
    names = queries.SHARDS[:n]
    taken = _by_turns(names, size)
    assert [names[k] for k in sharding.lookup_table(names, size)] == [taken[s] for s in range(size)]


def test_placement_with_null_and_repeated_keys(spark):
    names, size = queries.SHARDS[:5], 503
    taken = _by_turns(names, size)
    keys = [None, 0, -1, 7, 7, 2**62, *range(100, 400)]
    got = sharding.assign_shards(spark.createDataFrame([(k,) for k in keys], "doc_id long"), "doc_id", names, size).collect()
    assert len(got) == len(keys)
    for r in got:
        text = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(text.encode()).hexdigest()[:12], 16) % size
        assert (r.slot, names[r.shard]) == (slot, taken[slot])


def test_the_oracle_holds_the_stated_table():
    taken = _by_turns(queries.SHARDS, sharding.TABLE_SIZE)
    owners = ",".join(str(queries.SHARDS.index(taken[s])) for s in range(sharding.TABLE_SIZE))
    assert f"'{owners}'" in queries.oracle()["op3_sharding"]
