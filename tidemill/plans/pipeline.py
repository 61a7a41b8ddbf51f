"""Pipelines: a source, a table-to-table function and a sink; graphs of such tasks; a catalog of them in YAML."""

from __future__ import annotations

import copy
import importlib
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from tidemill.sources import sinks, tables


@dataclass(eq=False)
class Task:
    """read -> ``function(data, **kwargs)`` -> write. Without a source the function gets only its keywords, without a sink nothing is written."""

    function: Callable[..., Any]
    source: Any = None
    sink: Any = None
    kwargs: dict[str, Any] = field(default_factory=dict)
    name: str = ""
    upstream: list[Task] = field(default_factory=list)
    downstream: list[Task] = field(default_factory=list)

    def then(self, *others: Task) -> Task:
        """Runs ``others`` after this one; gives back the last of them."""
        for t in others:
            self.downstream.append(t)
            t.upstream.append(self)
        return others[-1]

    def run(self, spark: SparkSession) -> Any:
        out = self.function(**self.kwargs) if self.source is None else self.function(self.source.read(spark), **self.kwargs)
        if self.sink is not None:
            self.sink.write(out)
        return out


@dataclass(eq=False)
class Graph:
    """Tasks in any order; a task may be a graph itself."""

    tasks: list[Any]
    name: str = ""
    upstream: list[Any] = field(default_factory=list)
    downstream: list[Any] = field(default_factory=list)

    then = Task.then

    def roots(self) -> list[Any]:
        return [t for t in self.tasks if not t.upstream]

    def ordered(self) -> list[Any]:
        """Every task after all those upstream of it."""
        waiting = {id(t): len([u for u in t.upstream if u in self.tasks]) for t in self.tasks}
        ready, out = deque(t for t in self.tasks if not waiting[id(t)]), []
        while ready:
            t = ready.popleft()
            out.append(t)
            for d in t.downstream:
                if id(d) in waiting:
                    waiting[id(d)] -= 1
                    if not waiting[id(d)]:
                        ready.append(d)
        if len(out) != len(self.tasks):
            raise ValueError("the tasks form a cycle")
        return out

    def run(self, spark: SparkSession) -> dict[str, Any]:
        """Runs all tasks in order, sub-graphs included; results by name."""
        return {t.name or str(i): t.run(spark) for i, t in enumerate(self.ordered())}

    def dot(self) -> str:
        """The graph in DOT."""
        names = {id(t): t.name or f"task{i}" for i, t in enumerate(self.tasks)}
        edges = [f'  "{names[id(t)]}" -> "{names[id(d)]}";' for t in self.tasks for d in t.downstream if id(d) in names]
        return "\n".join(["digraph {", *(f'  "{n}";' for n in names.values()), *edges, "}"])


def breadth_first(root: Any, mode: str = "upstream") -> list[Any]:
    """All tasks reachable from ``root`` up or down the graph, nearest first, each once."""
    seen, out, queue = {id(root)}, [], deque([root])
    while queue:
        t = queue.popleft()
        out.append(t)
        for x in getattr(t, mode):
            if id(x) not in seen:
                seen.add(id(x))
                queue.append(x)
    return out


def shells(roots: Iterable[Any]) -> list[list[Any]]:
    """Tasks by distance from the roots; those of one shell may run side by side."""
    level, seen, out = list(roots), set(), []
    while level:
        level = [t for t in {id(t): t for t in level}.values() if id(t) not in seen]
        if level:
            seen |= {id(t) for t in level}
            out.append(level)
        level = [d for t in level for d in t.downstream]
    return out


def with_paths(catalog: Any, root: str) -> Any:
    """A copy of a nested catalog in which ``{}`` in any text is ``root``; other braces, numbers and flags stay."""
    if isinstance(catalog, dict):
        return {k: with_paths(v, root) for k, v in catalog.items()}
    if isinstance(catalog, list):
        return [with_paths(v, root) for v in catalog]
    return catalog.replace("{}", root) if isinstance(catalog, str) else copy.deepcopy(catalog)


class Catalog:
    """Named operations of a YAML file. Each has ``function`` (module, name, kwargs) and may have ``input`` and ``output`` (type and the fields of that source or sink). Only modules under ``allowed`` are imported."""

    def __init__(self, path: str = "", allowed: tuple[str, ...] = ("tidemill",)):
        self.path, self.allowed = path, allowed
        self.operations: dict[str, Any] | None = None

    def load(self, file: str) -> Catalog:
        import yaml

        with open(file, encoding="utf-8") as f:
            self.operations = with_paths(yaml.safe_load(f) or {}, self.path)
        return self

    def task(self, name: str) -> Task:
        if self.operations is None:
            raise AttributeError("no catalog is loaded")
        entry = self.operations[name]
        module = entry["function"]["module"]
        if not any(module == a or module.startswith(a + ".") for a in self.allowed):
            raise ValueError(f"module {module} isn't allowed")
        function = getattr(importlib.import_module(module), entry["function"]["name"])
        make = lambda kind, where: None if kind is None else getattr(where, kind["type"])(**{k: v for k, v in kind.items() if k != "type"})
        return Task(function, make(entry.get("input"), tables), make(entry.get("output"), sinks), entry["function"].get("kwargs") or {}, name)

    def run(self, spark: SparkSession, name: str) -> Any:
        return self.task(name).run(spark)


def pod_name(operation: str, dag: str = "", prefix: str = "") -> str:
    """A name that a cluster manager accepts: lower case, dashes for underscores, 63 characters at most."""
    return "-".join(x for x in (dag, operation, prefix) if x).replace("_", "-").lower()[:63]


def submit_command(operation: str, path: str, catalog: str, master: str = "k8s://https://kubernetes.default", image: str | None = None, conf: dict[str, str] | None = None) -> list[str]:
    """The command line that runs one operation of a catalog on a cluster."""
    settings = {"spark.kubernetes.driver.pod.name": pod_name(operation)} | ({"spark.kubernetes.container.image": image} if image else {}) | (conf or {})
    return ["spark-submit", "--master", master, "--deploy-mode", "cluster", *(x for k, v in sorted(settings.items()) for x in ("--conf", f"{k}={v}")), "-m", "tidemill.run", operation, path, catalog]
