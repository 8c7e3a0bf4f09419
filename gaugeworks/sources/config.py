"""Workspace configuration: TOML files, validation, assembling a run's input."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

#: File names looked for in the current folder; both at once are an error.
CONFIG_FILES = ("gaugeworks.toml", ".gaugeworks.toml")
WORKSPACE = ".gaugeworks"
STYLES = ("exact_match", "multiple_choice")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Style:
    """exact_match: answer column. multiple_choice: choices from columns or one column, and one way to the answer."""

    kind: str
    answer_column: str | None = None
    choice_columns: tuple[str, ...] = ()
    choice_column: str | None = None
    labels: tuple[str, ...] = ()
    index_column: str | None = None
    index_base: int = 0
    label_column: str | None = None
    correct_column: str | None = None
    seed_column: str | None = None

    def validate(self) -> None:
        if self.kind not in STYLES:
            raise ConfigError(f"unknown style {self.kind!r}")
        if self.kind == "exact_match":
            if not self.answer_column:
                raise ConfigError("exact_match needs an answer column")
            return
        if not self.labels or len(set(self.labels)) != len(self.labels):
            raise ConfigError("choice labels must be there and differ")
        if bool(self.choice_columns) == bool(self.choice_column):
            raise ConfigError("choices come from columns or from one column")
        if self.choice_columns and len(self.choice_columns) != len(self.labels):
            raise ConfigError("there must be as many labels as choice columns")
        if sum(x is not None for x in (self.index_column, self.label_column, self.correct_column)) != 1:
            raise ConfigError("give one of index, label and correct-choice column")
        if self.correct_column is not None and self.correct_column not in self.choice_columns:
            raise ConfigError("the correct choice must be one of the choice columns")


@dataclass(frozen=True)
class Evaluation:
    name: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    style: Style | None = None
    metrics: tuple = ()

    def validate(self) -> None:
        from gaugeworks.operators.confusion import selected

        if self.kind == "custom_code":
            if not self.params.get("command"):
                raise ConfigError(f"{self.name}: the command is empty")
        elif self.kind == "custom_nocode":
            if self.style is None:
                raise ConfigError(f"{self.name}: a style is needed")
            self.style.validate()
            names = [m if isinstance(m, str) else m.get("name") for m in self.metrics]
            if len(set(names)) != len(names):
                raise ConfigError(f"{self.name}: a metric is named twice")
            if names and self.style.kind == "exact_match":
                raise ConfigError(f"{self.name}: output metrics are for multiple choice")
            selected(self.metrics, True)
            if "prompt_template_file" in self.params and not os.path.isfile(self.params["prompt_template_file"]):
                raise ConfigError(f"{self.name}: there is no template {self.params['prompt_template_file']!r}")


def _style(table: dict) -> Style:
    choices, answer = table.get("choices", {}), table.get("answer", {})
    if isinstance(answer, str):
        answer = {"column": answer}
    return Style(
        kind=table.get("type", ""), answer_column=answer.get("column") or table.get("answer_column"),
        choice_columns=tuple(choices.get("columns", ())), choice_column=choices.get("column"), labels=tuple(table.get("choice_labels", ())),
        index_column=answer.get("index_column"), index_base=int(answer.get("index_base", 0)), label_column=answer.get("label_column"),
        correct_column=answer.get("correct_choice_column"), seed_column=table.get("shuffle", {}).get("seed_column"),
    )


def parse(text: str) -> dict[str, Evaluation]:
    out = {}
    for name, table in tomllib.loads(text).get("benchmarks", {}).items():
        table = dict(table)
        kind = table.pop("type", "builtin")
        style = _style(table.pop("style")) if "style" in table else None
        out[name] = Evaluation(name, kind, {k: v for k, v in table.items() if k != "metrics"}, style, tuple(table.get("metrics", ())))
    return out


def load(folder: str = ".") -> dict[str, Evaluation]:
    """The configuration in a folder (not its parents); none is no evaluations."""
    found = [p for f in CONFIG_FILES if os.path.isfile(p := os.path.join(folder, f))]
    if len(found) > 1:
        raise ConfigError(f"both {' and '.join(CONFIG_FILES)} are there")
    if not found:
        return {}
    with open(found[0], encoding="utf-8") as f:
        return parse(f.read())


def find_workspace(start: str = ".") -> str | None:
    """The nearest folder upward that has a workspace."""
    at = os.path.abspath(start)
    while True:
        if os.path.isdir(os.path.join(at, WORKSPACE)):
            return os.path.join(at, WORKSPACE)
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def init_workspace(folder: str = ".") -> str:
    path = os.path.join(os.path.abspath(folder), WORKSPACE)
    os.makedirs(path, exist_ok=True)
    return path


#: What a run of a no-code evaluation may override.
NOCODE_OVERRIDES = ("model", "limit", "prompt_template_file")


def assembled(evaluation: Evaluation, given: dict | None) -> tuple[dict, Sequence[str]]:
    """The input of a run and the keys that the command line overrode.

    Built-in evaluations: what is given replaces the configuration. Custom code: keys merge, the given ones win. No-code:
    only some keys may be given.
    """
    own = dict(evaluation.params)
    if given is None:
        return own, ()
    if evaluation.kind == "builtin":
        return dict(given), ()
    if evaluation.kind == "custom_nocode" and (odd := sorted(set(given).difference(NOCODE_OVERRIDES))):
        raise ConfigError(f"can't override {', '.join(odd)}")
    return own | given, tuple(sorted(k for k in given if k in own and own[k] != given[k]))
