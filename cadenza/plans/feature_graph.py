"""Feature graphs: modules that read each other, declared as text or dictionaries, run as one DataFrame plan.

The context that modules need is summed along the graph; the base frames are padded by
it once, all windows share one partitioning, and the padding is cut off at the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators import features as ft
from cadenza.operators.frames import BLOCK, in_order, padded, trimmed


@dataclass
class Module:
    name: str
    type: str
    sources: list[str] = field(default_factory=list)
    options: dict[str, list[str]] = field(default_factory=dict)

    def number(self, key: str, default: float) -> float:
        return float(self.options[key][0]) if key in self.options else default

    def numbers(self, key: str) -> list[float] | None:
        return [float(v) for v in self.options[key]] if key in self.options else None


def parse(text: str) -> list[Module]:
    """Modules from blocks `module { key value ... }`, in their order."""
    out = []
    for body in re.findall(r"module\s*\{(.*?)\}", text, re.S):
        pairs = {words[0]: words[1:] for line in body.splitlines() if (words := line.split())}
        if "name" not in pairs or "type" not in pairs:
            raise ValueError(f"a module needs a name and a type: {body.strip()!r}")
        out.append(Module(pairs.pop("name")[0], pairs.pop("type")[0], pairs.pop("sources", []), pairs))
    return out


def render(modules: list[Module]) -> str:
    """The text that `parse` reads."""
    blocks = []
    for m in modules:
        lines = [f"name {m.name}", f"type {m.type}", *[f"sources {' '.join(m.sources)}"] * bool(m.sources), *[f"{k} {' '.join(v)}" for k, v in m.options.items()]]
        blocks.append("module\n{\n" + "".join(f"  {x}\n" for x in lines) + "}\n")
    return "\n".join(blocks)


def to_dot(modules: list[Module]) -> str:
    """The graph for Graphviz."""
    lines = [f'  "{m.name}" [label="{m.name}\\n{m.type}"];' for m in modules]
    lines += [f'  "{s}" -> "{m.name}";' for m in modules for s in m.sources]
    return "digraph features {\n" + "\n".join(lines) + "\n}\n"


#: Types whose vectors are the frames that the graph is applied to.
BASES = {"audiofile", "pre"}
Builder = Callable[[Module, list[ft.Vector]], ft.Vector]


def _windowed(fn: Callable, *names: tuple[str, int]) -> Builder:
    return lambda m, v: fn(*v[0], in_order(), *[int(m.number(k, d)) for k, d in names])


BUILDERS: dict[str, Builder] = {
    "fft": lambda m, v: ft.fft(*v[0], bool(m.number("magnitude", 1)), bool(m.number("log", 0))),
    "mel": lambda m, v: ft.mel(*v[0], m.number("sample_rate", 16000), bool(m.number("root", 0)), int(m.options["bins"][0]) if "bins" in m.options else None),
    "power": lambda m, v: ft.power(*v[0]),
    "mel_power": lambda m, v: ft.mel_power(*v[0]),
    "dct": lambda m, v: ft.dct(*v[0], int(m.number("dim", 12)), bool(m.number("zeroth_comp", 0))),
    "delta": _windowed(ft.delta, ("width", 2)),
    "normalization": lambda m, v: ft.normalization(*v[0], m.numbers("mean") or [0.0] * v[0][1], m.numbers("scale") or [x**-0.5 for x in m.numbers("var") or [1.0] * v[0][1]]),
    "lin_transform": lambda m, v: ft.lin_transform(*v[0], m.numbers("matrix"), m.numbers("bias")),
    "merge": lambda m, v: ft.merge(*v),
    "mean_subtractor": _windowed(ft.mean_subtractor, ("left", 75), ("right", 75)),
    "concat": _windowed(ft.concat, ("left", 0), ("right", 0)),
    "vtln": lambda m, v: ft.vtln(*v[0], m.number("warp_factor", 1.0), m.options.get("kind", ["pwlin"])[0], int(m.number("sinc_interpolation_rad", 8)), bool(m.number("lanczos_window", 1)), m.number("pwlin_turnpoint", 0.8), m.numbers("params") or ()),
    "vtln_all_pass": lambda m, v: ft.vtln_all_pass(*v[0], m.number("warp_factor", 1.0)),
    "sr_norm": lambda m, v: ft.sr_norm(*v[0], int(m.number("in_frames", 1)), int(m.number("out_frames", 1)), m.number("speech_rate", 1.0), int(m.number("lanczos_order", 4))),
    "quanteq": lambda m, v: ft.quanteq(*v[0], m.numbers("alpha"), m.numbers("gamma"), m.numbers("quant_max")),
}


def register(kind: str, builder: Builder) -> None:
    """Add a module type."""
    BUILDERS[kind] = builder


def own_context(m: Module) -> int:
    """Frames that a module reads to either side, at most."""
    if m.type == "delta":
        return int(m.number("width", 2))
    if m.type in ("mean_subtractor", "concat"):
        default = 75 if m.type == "mean_subtractor" else 0
        return int(max(m.number("left", default), m.number("right", default)))
    return 0


class FeatureGraph:
    """Modules in an order in which sources come first; the last one is the output."""

    def __init__(self, modules: list[Module]) -> None:
        seen: set[str] = set()
        for m in modules:
            if m.name in seen:
                raise ValueError(f"module {m.name} is declared twice")
            if m.type not in BASES and m.type not in BUILDERS:
                raise ValueError(f"unknown module type {m.type}")
            if missing := [s for s in m.sources if s not in seen]:
                raise ValueError(f"module {m.name} reads {missing[0]}, which is not declared before it")
            if m.type not in BASES and not m.sources:
                raise ValueError(f"module {m.name} has no source")
            seen.add(m.name)
        self.modules = modules

    @classmethod
    def from_text(cls, text: str) -> FeatureGraph:
        return cls(parse(text))

    def needed(self) -> list[Module]:
        """The modules that the output reads."""
        wanted, out = {self.modules[-1].name}, []
        for m in reversed(self.modules):
            if m.name in wanted:
                out.append(m)
                wanted.update(m.sources)
        return out[::-1]

    def unused(self) -> list[str]:
        return [m.name for m in self.modules if m not in self.needed()]

    def context(self) -> int:
        """Frames by which the base must be padded."""
        total: dict[str, int] = {}
        for m in self.needed():
            total[m.name] = own_context(m) + max([total[s] for s in m.sources], default=0)
        return total[self.modules[-1].name]

    def apply(self, frames: DataFrame, dim: int, block: int = BLOCK) -> tuple[DataFrame, int]:
        """utt, frame, n and the output x of all frames, and its dimension; `frames` has utt, frame, n and x."""
        context = self.context()
        df = padded(frames.select("utt", "frame", "n", "x"), context, block) if context else frames.select("utt", "frame", "n", "x")
        df, out = self.apply_padded(df, dim)
        return (trimmed(df, block) if context else df), out

    def apply_padded(self, df: DataFrame, dim: int) -> tuple[DataFrame, int]:
        """The output x in place of the base x, and its dimension; rows have their context within (utt, block), if any module needs it."""
        dims: dict[str, int] = {}
        for m in self.needed():
            if m.type in BASES:
                df, dims[m.name] = df.withColumn(f"m_{m.name}", F.col("x")), dim
                continue
            y, dims[m.name] = BUILDERS[m.type](m, [(F.col(f"m_{s}"), dims[s]) for s in m.sources])
            df = df.withColumn(f"m_{m.name}", y)
        last = self.modules[-1].name
        return df.withColumn("x", F.col(f"m_{last}")).drop(*[f"m_{m.name}" for m in self.needed()]), dims[last]


def graph_edges(texts: DataFrame, key: str) -> DataFrame:
    """key and edge: the edges, as Graphviz reads them, of the graphs that a table (key, text) describes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x.strip() for x in to_dot(parse(t)).splitlines() if " -> " in x] for t in batch.column("text").to_pylist()]
            rows = np.repeat(np.arange(batch.num_rows), [len(e) for e in found])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array([x for e in found for x in e], pa.string())], names=[key, "edge"])

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, edge string")


def graph_messages(texts: DataFrame, key: str) -> DataFrame:
    """key and message: what is wrong with the graphs that a table (key, text) describes, null where nothing is."""

    def message(text: str) -> str | None:
        try:
            FeatureGraph.from_text(text)
        except ValueError as error:
            return str(error)
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(map(message, batch.column("text").to_pylist())), pa.string())], names=[key, "message"])

    return texts.select(key, "text").mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, message string")
