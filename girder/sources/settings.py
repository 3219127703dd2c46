"""Settings files: every name known, every value within its bounds, or a refusal that names them all (SRC-21)."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from girder.functions.rules import Refused

SHA256 = re.compile(r"[a-f0-9]{64}")


@dataclass(frozen=True)
class Setting:
    """fits: whether a value may stand. needed: whether it must."""

    fits: Callable[[Any], bool]
    needed: bool = True


def whole(low: int, high: int) -> Callable[[Any], bool]:
    return lambda v: type(v) is int and low <= v <= high


def rate(most: float) -> Callable[[Any], bool]:
    return lambda v: type(v) in (int, float) and math.isfinite(v) and 0 < v <= most


def one_of(*values: Any) -> Callable[[Any], bool]:
    return lambda v: any(type(v) is type(x) and v == x for x in values)


def is_digest(v: Any) -> bool:
    return isinstance(v, str) and SHA256.fullmatch(v) is not None


def pins(files: list[str]) -> Callable[[Any], bool]:
    """A digest for each of the files and for no other."""
    return lambda v: isinstance(v, dict) and set(v) == set(files) and all(map(is_digest, v.values()))


def class_list(v: Any) -> bool:
    return isinstance(v, list) and 1 <= len(v) <= 10 and len(set(map(str, v))) == len(v) and all(isinstance(n, str) and 1 <= len(n) <= 40 for n in v)


def training(files: list[str]) -> dict[str, Setting]:
    """A segmentation training. Bounds here and below are fixed values."""
    return {
        "schema_version": Setting(whole(1, 1)), "purpose": Setting(one_of("smoke", "experiment")), "seed": Setting(whole(0, 2**32 - 1)), "epochs": Setting(whole(1, 1000)),
        "train_images": Setting(whole(2, 5000)), "valid_images": Setting(whole(2, 5000)), "batch_size": Setting(whole(1, 32)), "grad_accum_steps": Setting(whole(1, 32)),
        "lr": Setting(rate(0.01)), "corpus_sha256": Setting(pins(files)), "class_names": Setting(class_list, False), "checkpoint_selection": Setting(one_of("best_validation", "last_epoch"), False),
        "initial_checkpoint_sha256": Setting(is_digest, False), "continuation_checkpoint_sha256": Setting(is_digest, False),
    }


#: Kinds of a pilot's corpus, the first where none is named.
KINDS = ("reviewed_boxes", "prepared_coco")


def pilot(files: dict[str, list[str]], kinds: tuple[str, ...] = KINDS) -> Callable[[dict], dict[str, Setting]]:
    """A short training on boxes; which files must be pinned follows from the kind of its corpus (files: by kind)."""

    def rules(values: dict) -> dict[str, Setting]:
        kind = values.get("corpus_kind", kinds[0])
        return {
            "schema_version": Setting(whole(1, 1)), "purpose": Setting(one_of("pilot_box_training")), "seed": Setting(whole(0, 2**32 - 1)), "epochs": Setting(whole(1, 10)), "batch_size": Setting(whole(1, 4)),
            "grad_accum_steps": Setting(whole(1, 8)), "lr": Setting(rate(0.001)), "checkpoint_selection": Setting(one_of("last_epoch")), "corpus_kind": Setting(one_of(*kinds), False),
            "class_names": Setting(class_list, False), "corpus_sha256": Setting(pins(files.get(kind, []) if isinstance(kind, str) else [])),
        }

    return rules


EXTENSION = {"schema_version": Setting(whole(1, 1)), "parent_report_sha256": Setting(is_digest), "parent_state_sha256": Setting(is_digest), "target_epochs": Setting(whole(2, 10))}
#: Epochs that an extension may add.
MOST_ADDED = 8


def checked(values: Any, rules: dict[str, Setting] | Callable[[dict], dict[str, Setting]]) -> dict:
    """The values, if they keep all rules."""
    if not isinstance(values, dict):
        raise Refused("settings are no table of names")
    rules = rules(values) if callable(rules) else rules
    wrong = {
        "unknown": sorted(str(k) for k in values.keys() - rules.keys()),
        "missing": sorted(k for k, r in rules.items() if r.needed and k not in values),
        "out of bounds": sorted(k for k, r in rules.items() if k in values and not r.fits(values[k])),
    }
    if found := {k: v for k, v in wrong.items() if v}:
        raise Refused(f"settings are refused: {found}")
    return dict(values)


def extended(plan: dict, parent: dict, report_sha256: str, corpus: dict[str, str]) -> dict:
    """The first further epoch's settings of a parent run (its config and status) under an extension plan.

    The parent's report must be the one the plan pins, its corpus unchanged, and the plan add 1 to 8 epochs.
    """
    checked(plan, EXTENSION)
    if plan["parent_report_sha256"] != report_sha256:
        raise Refused("the parent's report has changed")
    done = parent["config"]["epochs"]
    if parent.get("status") != "completed" or not done < plan["target_epochs"] <= done + MOST_ADDED:
        raise Refused("an extension adds 1 to 8 epochs to a completed run")
    if changed := sorted(k for k, v in parent["config"]["corpus_sha256"].items() if corpus.get(k) != v):
        raise Refused(f"the corpus has changed: {changed}")
    return {**parent["config"], "epochs": done + 1, "continuation_checkpoint_sha256": plan["parent_state_sha256"]}
