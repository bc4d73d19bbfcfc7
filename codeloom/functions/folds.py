"""Ordered folds over arrays that emit as they go."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD_BLOCK = 1000


def emitting_fold(
    items: str, state: dict[str, str], step: str, emitted: str, finish: str, block: int = FOLD_BLOCK
) -> Column:
    """Fold the array column ``items`` from left to right and return what was emitted.
    See ``fold_sql``.
    """
    return F.expr(fold_sql(items, state, step, emitted, finish, block))


def fold_sql(
    items: str, state: dict[str, str], step: str, emitted: str, finish: str, block: int = FOLD_BLOCK
) -> str:
    """The SQL of a fold over the array ``items``, a column or a lambda's variable.

    ``state`` maps the fields carried along to their first values, ``step`` is the
    SQL of the next state from ``acc`` and the item ``u``, with a field ``done`` that
    is ``acc.done`` and whatever is emitted, of type ``emitted``; ``finish`` is the
    SQL of the result from ``acc``.

    Spark copies the state at every step, and with it all that was emitted. Items are
    therefore folded a block at a time, each with a ``done`` of its own, so that a
    long array does not cost the square of its length.
    """
    nothing = f"cast(array() as array<{emitted}>)"

    def carry(source: str) -> str:
        return ", ".join(f"'{f}', {source}.{f}" for f in state)

    first = ", ".join(f"'{f}', {value}" for f, value in state.items())
    in_block = f"aggregate(b, named_struct({carry('o')}, 'done', {nothing}), (acc, u) -> {step})"
    blocks = f"transform(sequence(0, greatest(size({items}) - 1, 0), {block}), i -> slice({items}, i + 1, {block}))"
    return f"""aggregate({blocks}, named_struct({first}, 'done', {nothing}),
              (o, b) -> transform(array({in_block}),
                  r -> named_struct({carry('r')}, 'done', concat(o.done, r.done)))[0],
              acc -> {finish})"""


def placed_parts(parts: str) -> Column:
    """(part, start) structs of the array that the SQL ``parts`` gives, where one character
    stands behind each part. The parts are worked out once, inside their own row.
    """
    starts = fold_sql(
        "sizes", {"at": "0L"}, "named_struct('at', acc.at + u + 1, 'done', concat(acc.done, array(acc.at)))", "bigint", "acc.done"
    )
    return F.expr(
        f"""transform(array({parts}), ps -> zip_with(ps, transform(array(transform(ps, p -> length(p))), sizes -> {starts})[0],
              (p, s) -> named_struct('part', p, 'start', s)))[0]"""
    )
