"""Spans of regular expressions as column expressions, without Python on the executors.

A span is a struct (start, end, found): code points, end exclusive, and the matched
text.  ``split`` with no limit and ``regexp_extract_all`` walk a text in the same
leftmost non-overlapping way, so the lengths of their results give the positions.

Lists are built by ``fold``, in blocks, so a text with n matches takes time in
proportion to n (appending to one list would copy it n times).

Patterns must not be able to match an empty text, must repeat groups only
possessively (other repeated groups recurse and overflow the stack on long texts),
and should start where a run starts, so that a long run is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,found:string>>"
CHUNK = 1024


def quoted(value: str) -> str:
    """A string literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(name: str, value: str, body: str) -> str:
    """``body`` with the value, computed once, under ``name``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def fold(items: str, state: str, step: Callable[[str, str], tuple[str, str]], kind: str) -> str:
    """SQL for the values that ``step(state, item)``, the next state and a value, gives along ``items``, without nulls.

    ``kind`` is the type of the list of them.  ``items`` should be a column or a name of ``let``: it is used
    several times.  The last of the blocks' results holds the state that the next one starts with.
    """
    size = f"cast(greatest(64, ceil(sqrt(size({items})))) as int)"
    begun = lambda s: f"named_struct('state', {s}, 'out', cast(array() as {kind}))"
    after, out = step("acc.state", "x")
    add = f"(acc, x) -> named_struct('state', {after}, 'out', array_append(acc.out, {out}))"
    block = f"(rs, b) -> array_append(rs, aggregate(slice({items}, b * {size} + 1, {size}), {begun('element_at(rs, -1).state')}, {add}))"
    numbers = f"sequence(0, cast(floor((size({items}) - 1) / {size}) as int))"
    lists = f"aggregate({numbers}, array({begun(state)}), {block}, rs -> filter(flatten(transform(rs, r -> r.out)), v -> v is not null))"
    return f"if(size({items}) > 0, {lists}, cast(array() as {kind}))"


def spans(text: str, pattern: str, hint: str | None = None) -> str:
    """SQL for all matches of ``pattern`` in the column ``text``; texts that do not contain ``hint`` are not searched."""
    p = quoted(pattern)
    ended = "acc.state + x.before + coalesce(length(x.found), 0)"
    step = lambda at, x: (ended, f"if(x.found is null, null, named_struct('start', acc.state + x.before, 'end', {ended}, 'found', x.found))")
    pairs = f"zip_with(transform(split({text}, {p}, -1), t -> length(t)), regexp_extract_all({text}, {p}, 0), (before, found) -> named_struct('before', before, 'found', found))"
    has = f"{text} rlike {p}" if hint is None else f"contains({text}, {quoted(hint)}) and {text} rlike {p}"
    return f"if({has}, {let('pairs', pairs, fold('pairs', '0L', step, SPAN))}, cast(array() as {SPAN}))"


def chunks(text: str) -> str:
    """SQL for the text in parts of ``CHUNK`` characters: ``piece`` need not count characters from the text's start."""
    return f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"


def piece(parts: str, start: str, end: str) -> str:
    """SQL for the characters from ``start`` to ``end`` of a text of which ``parts`` are the chunks."""
    first = f"cast(({start}) div {CHUNK} as int)"
    some = f"slice({parts}, {first} + 1, cast(({end}) div {CHUNK} as int) - {first} + 1)"
    return f"substring(array_join({some}, ''), cast(({start}) % {CHUNK} + 1 as int), cast(({end}) - ({start}) as int))"


def listed(found: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({found}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
