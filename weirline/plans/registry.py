"""Names for decoders, filters, encoders and outputs, so that a configuration can call them and users can add their own.

    @plugin("decoder", "my_format")
    def my_format(**options): ...        # -> Column

Kinds: input (spark, **options) -> DataFrame of messages; splitter (df,
**options) -> DataFrame with seq and record; decoder and encoder (**options) ->
Column; filter and stream_filter (df, **options) -> DataFrame; output (df,
encoder, **options) -> None.  A stream_filter is what a filter of the same name
is in a stream.
"""

from __future__ import annotations

from collections.abc import Callable

KINDS = ("input", "splitter", "decoder", "filter", "encoder", "output")
PLUGINS: dict[str, dict[str, Callable]] = {k: {} for k in (*KINDS, "stream_filter")}


def plugin(kind: str, name: str) -> Callable[[Callable], Callable]:
    def register(f: Callable) -> Callable:
        if kind not in PLUGINS:
            raise ValueError(f"no kind {kind}")
        PLUGINS[kind][name] = f
        return f

    return register


def get(kind: str, name: str) -> Callable:
    try:
        return PLUGINS[kind][name]
    except KeyError:
        raise KeyError(f"no {kind} {name}; there are {', '.join(sorted(PLUGINS[kind]))}") from None
