"""Which message answers a call: one linear search per conversation over Arrow batches of message kinds and ids.

An array lambda has no hash table: it compares every call with every message, and a fold that collects its finds copies them at every
step. Texts stay on the JVM side; a batch holds kinds, ids and, on the way back, positions.
"""
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

OTHER, TOOL, MARKED = 0, 1, 2   # kinds of messages: none that answers, a tool's output, a user's message with a marked result
FOUND = ArrayType(StructType([StructField(name, IntegerType()) for name in ("message", "call", "answer")]))


def _positions(found: list) -> pa.Array:
    """Lists of (message, call, answer), null for a missing conversation, as an Arrow column."""
    flat = np.array(list(chain.from_iterable(f or () for f in found)), dtype=np.int32).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["message", "call", "answer"])
    offsets = np.concatenate([[0], np.cumsum([len(f or ()) for f in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.array([f is None for f in found] + [False])), fields)


def search_ahead(kinds: list, ids: list, calls: list, look_ahead: int, marked_id) -> list:
    """(message, call, answer) of every call in order, answer -1 where none is found.

    A call is answered by the first of the next ``look_ahead`` messages that is a tool's output with its id (no id answers no id), or,
    for calls with ``marked_id``, that is marked. The search moves on behind each answer; calls in messages before it are passed over.
    """
    found, cursor = [], -1
    for message, wanted in enumerate(calls):
        if message <= cursor or not wanted:
            continue
        cursor = message
        for call, call_id in enumerate(wanted):
            near = range(cursor + 1, min(cursor + look_ahead + 1, len(kinds)))
            answer = next((at for at in near if (kinds[at] == TOOL and ids[at] == call_id) or (kinds[at] == MARKED and call_id == marked_id)), -1)
            found.append((message, call, answer))
            cursor = max(cursor, answer)
    return found


def search_by_id(kinds: list, ids: list, calls: list) -> list:
    """(message, call, answer) of every call in order; the answer is the last tool output with the call's id, calls without id have none."""
    last = {call_id: at for at, (kind, call_id) in enumerate(zip(kinds, ids)) if kind == TOOL and call_id is not None}
    return [(message, call, last.get(call_id, -1)) for message, wanted in enumerate(calls) for call, call_id in enumerate(wanted or ())]


def _over_batches(search, kinds: pa.Array, ids: pa.Array, calls: pa.Array, marked_id: str = None) -> pa.Array:
    """Positions of every conversation; ids become numbers (none stays none), and the nested lists are cut from flat ones."""
    wanted = calls.values
    coded = pa.concat_arrays([ids.values, wanted.values]).dictionary_encode()
    marked = pc.index(coded.dictionary, marked_id).as_py()
    numbers = [None if at < 0 else at for at in coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()]
    kind, own, called = kinds.values.to_numpy(zero_copy_only=False).tolist(), numbers[:len(ids.values)], numbers[len(ids.values):]
    in_kinds, in_ids, in_calls, in_wanted = [a.offsets.to_numpy().tolist() for a in (kinds, ids, calls, wanted)]
    lists = [called[i:j] for i, j in zip(in_wanted, in_wanted[1:])]
    cut = lambda flat, offsets, row: flat[offsets[row]:offsets[row + 1]]
    known = kinds.is_valid().to_pylist()
    return _positions([search(cut(kind, in_kinds, row), cut(own, in_ids, row), cut(lists, in_calls, row), marked) if known[row] else None for row in range(len(kinds))])


def by_look_ahead(look_ahead: int, marked_id: str):
    """Column function (kinds, ids, call ids) -> positions, with a bounded look-ahead."""
    @F.arrow_udf(FOUND)
    def find(kinds: pa.Array, ids: pa.Array, calls: pa.Array) -> pa.Array:
        return _over_batches(lambda k, i, c, marked: search_ahead(k, i, c, look_ahead, marked), kinds, ids, calls, marked_id)
    return find


@F.arrow_udf(FOUND)
def by_id(kinds: pa.Array, ids: pa.Array, calls: pa.Array) -> pa.Array:
    """Column function (kinds, ids, call ids) -> positions, over the whole conversation."""
    return _over_batches(lambda k, i, c, marked: search_by_id(k, i, c), kinds, ids, calls)
