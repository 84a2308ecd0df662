"""Configurations of a run: read from JSON, checked before anything is computed."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path

from loomgraph.operators.scoring import DECODERS
from loomgraph.operators.train import LOSSES, Settings

LAYERS = ("embedding", "feature", "linear", "gcn", "sage_mean", "sage_gcn", "gat", "rgcn", "concat")
OPTIMIZERS = ("sgd", "adagrad", "adam")


@dataclass(frozen=True)
class Layer:
    """One layer: its kind and dims; heads of attention; inputs of concat are layers of the stage before."""

    kind: str
    input_dim: int = 0
    output_dim: int = 0
    heads: int = 1
    average: bool = True
    bias: bool = False
    activation: str = "none"


@dataclass(frozen=True)
class Optimizer:
    """An optimizer, and the layers or tables whose parameters it steps; none named: all that no other one names."""

    kind: str = "adagrad"
    lr: float = 0.1
    weight_decay: float = 0.0
    targets: tuple[str, ...] = ()


@dataclass(frozen=True)
class Source:
    paths: tuple[str, ...] = ()
    columns: dict = field(default_factory=lambda: {"src_column": 0, "edge_type_column": 1, "dst_column": 2})
    delim: str = "\t"
    header_length: int = 0
    fractions: tuple[float, ...] = (0.9, 0.05, 0.05)


@dataclass(frozen=True)
class Config:
    """task: links or classes. stages: layers side by side, stage after stage. out: folder of the prepared graph, versions and results."""

    task: str = "links"
    out: str = ""
    source: Source = Source()
    settings: Settings = Settings()
    epochs: int = 1
    stages: tuple[tuple[Layer, ...], ...] = ()
    optimizers: tuple[Optimizer, ...] = (Optimizer(),)
    metrics: tuple[str, ...] = ("MRR", "MR", "HITS@1", "HITS@10")


def _made(kind: type, value, where: str):
    """A dataclass of plain values; a name that it doesn't have is an error."""
    if not isinstance(value, dict):
        raise ValueError(f"{where}: expected an object")
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(value) - known):
        raise ValueError(f"{where}: unknown {', '.join(unknown)}")
    inner = {"source": Source, "settings": Settings}
    out = {}
    for name, x in value.items():
        at = f"{where}.{name}"
        if name in inner and kind is Config:
            out[name] = _made(inner[name], x, at)
        elif name == "stages":
            out[name] = tuple(tuple(_made(Layer, y, at) for y in stage) for stage in x)
        elif name == "optimizers":
            out[name] = tuple(_made(Optimizer, y, at) for y in x)
        else:
            out[name] = tuple(x) if isinstance(x, list) else x
    return kind(**out)


def checked(config: Config) -> Config:
    """The config, or a ValueError that names what doesn't hold."""
    s = config.settings
    problems = []
    if config.task not in ("links", "classes"):
        problems.append(f"no such task: {config.task}")
    if s.decoder not in DECODERS:
        problems.append(f"no such decoder: {s.decoder}")
    if s.loss not in LOSSES:
        problems.append(f"no such loss: {s.loss}")
    if s.decoder == "complex" and s.dim % 2:
        problems.append("complex vectors need an even dim")
    problems += [f"{name} must be positive" for name in ("dim", "batch_edges", "lr") if getattr(s, name) <= 0]
    if sum(config.source.fractions) > 1 + 1e-9 or any(f < 0 for f in config.source.fractions):
        problems.append("fractions must be parts of one")
    for o in config.optimizers:
        if o.kind not in OPTIMIZERS:
            problems.append(f"no such optimizer: {o.kind}")
    problems += _dims(config.stages, s.dim if config.task == "links" else None)
    try:
        optimizer_of(config.optimizers, [f"{k}.{i}" for k, stage in enumerate(config.stages) for i in range(len(stage))])
    except ValueError as e:
        problems.append(str(e))
    if problems:
        raise ValueError("; ".join(problems))
    return config


def _dims(stages: Sequence[Sequence[Layer]], last: int | None) -> list[str]:
    """What layers take in must be what the stage before gives; the first stage holds embeddings and features only."""
    problems = []
    given: list[int] = []
    for k, stage in enumerate(stages):
        now = []
        for layer in stage:
            wide = layer.output_dim * (layer.heads if layer.kind == "gat" and not layer.average else 1)
            if layer.kind not in LAYERS:
                problems.append(f"stage {k}: no such layer: {layer.kind}")
            elif layer.output_dim <= 0:
                problems.append(f"stage {k}: {layer.kind} needs an output_dim")
            elif k == 0 and layer.kind not in ("embedding", "feature"):
                problems.append(f"stage 0: {layer.kind} has no input")
            elif layer.kind in ("embedding", "feature"):
                pass
            elif layer.kind == "concat":
                if layer.output_dim != sum(given):
                    problems.append(f"stage {k}: concat gives {sum(given)}, not {layer.output_dim}")
            elif k and layer.input_dim != sum(given):
                problems.append(f"stage {k}: {layer.kind} takes {layer.input_dim}, but gets {sum(given)}")
            now.append(wide)
        given = now
    if stages and last is not None and sum(given) != last:
        problems.append(f"the last stage gives {sum(given)}, but the decoder takes {last}")
    return problems


def optimizer_of(optimizers: Sequence[Optimizer], targets: Sequence[str]) -> dict[str, Optimizer]:
    """The optimizer of each target (a layer as stage.place, or a table): the one that names it, else the one that names none."""
    named: dict[str, Optimizer] = {}
    rest = [o for o in optimizers if not o.targets]
    if len(rest) > 1:
        raise ValueError("only one optimizer may leave its targets open")
    for o in optimizers:
        for t in o.targets:
            if t in named:
                raise ValueError(f"{t} has two optimizers")
            named[t] = o
    missing = [t for t in targets if t not in named]
    if missing and not rest:
        raise ValueError(f"no optimizer for {', '.join(missing)}")
    return {t: named.get(t, rest[0] if rest else None) for t in [*targets, *(t for t in named if t not in targets)]}


def parameters(config: Config, n_nodes: int, n_rels: int) -> dict[str, tuple[int, ...]]:
    """The shape of each parameter: node and relation tables, and weights and biases of layers by stage.place."""
    s = config.settings
    out: dict[str, tuple[int, ...]] = {"nodes": (n_nodes, s.dim)}
    if config.task == "links":
        out |= {"rels": (n_rels, s.dim)} | ({"inverse": (n_rels, s.dim)} if s.inverse else {})
    for k, stage in enumerate(config.stages):
        for i, layer in enumerate(stage):
            name, shape = f"{k}.{i}", (layer.output_dim, layer.input_dim)
            if layer.kind in ("linear", "gcn", "sage_gcn"):
                out[f"{name}.weight"] = shape
            elif layer.kind == "sage_mean":
                out |= {f"{name}.self": shape, f"{name}.neighbours": shape}
            elif layer.kind == "gat":
                out |= {f"{name}.weight": (layer.heads, *shape), f"{name}.left": (layer.heads, layer.output_dim), f"{name}.right": (layer.heads, layer.output_dim)}
            elif layer.kind == "rgcn":
                out |= {f"{name}.self": shape, f"{name}.relations": (n_rels, *shape)}
            if layer.bias:
                out[f"{name}.bias"] = (layer.output_dim,)
    return out


def load(text_or_path: str | Path) -> Config:
    """From JSON, as text or a file."""
    text = str(text_or_path)
    return checked(_made(Config, json.loads(text if text.lstrip().startswith("{") else Path(text).read_text("utf-8")), "config"))


def dump(config: Config) -> str:
    """JSON with every value, defaults included; load() gives the same config."""

    def plain(x):
        if is_dataclass(x):
            return {f.name: plain(getattr(x, f.name)) for f in fields(x)}
        return [plain(y) for y in x] if isinstance(x, (tuple, list)) else x

    return json.dumps(plain(config), indent=1)


def generated(paths: Sequence[str], out: str, task: str = "links", **settings) -> Config:
    """A whole config for files, from defaults and what is given."""
    return checked(replace(Config(), task=task, out=out, source=replace(Source(), paths=tuple(paths)), settings=replace(Settings(), **settings)))
