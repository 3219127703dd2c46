"""Settings files against their bounds."""

import pytest

from girder.functions.rules import Refused
from girder.sources import settings

PIN = "a" * 64
TRAINING = {"schema_version": 1, "purpose": "smoke", "seed": 42, "epochs": 3, "train_images": 32, "valid_images": 8, "batch_size": 1, "grad_accum_steps": 1, "lr": 0.0001, "corpus_sha256": {"manifest.json": PIN}}
PILOT = {"schema_version": 1, "purpose": "pilot_box_training", "seed": 1, "epochs": 10, "batch_size": 1, "grad_accum_steps": 8, "lr": 0.001, "checkpoint_selection": "last_epoch", "corpus_sha256": {"boxes.json": PIN}}
FILES = {"reviewed_boxes": ["boxes.json"], "prepared_coco": ["coco.json", "report.json"]}


def test_sound_settings_pass():
    rules = settings.training(["manifest.json"])
    assert settings.checked(TRAINING, rules) == TRAINING
    more = TRAINING | {"class_names": ["crack"], "checkpoint_selection": "last_epoch", "initial_checkpoint_sha256": PIN}
    assert settings.checked(more, rules) == more
    assert settings.checked(PILOT, settings.pilot(FILES)) == PILOT
    coco = PILOT | {"corpus_kind": "prepared_coco", "corpus_sha256": {"coco.json": PIN, "report.json": PIN}}
    assert settings.checked(coco, settings.pilot(FILES)) == coco


@pytest.mark.parametrize(
    "change",
    [{"epoch": 3}, {"epochs": 0}, {"epochs": True}, {"epochs": 3.0}, {"seed": 2**32}, {"lr": 0}, {"lr": float("nan")}, {"lr": "0.1"}, {"lr": 0.02}, {"purpose": "other"}, {"corpus_sha256": {}}, {"corpus_sha256": {"manifest.json": "A" * 64}}, {"class_names": []}, {"class_names": ["a", "a"]}, {"checkpoint_selection": None}, {"continuation_checkpoint_sha256": "x"}, {"schema_version": 2}, {"schema_version": True}],
)
def test_training_settings_out_of_bounds(change):
    with pytest.raises(Refused, match=next(iter(change))):
        settings.checked(TRAINING | change, settings.training(["manifest.json"]))


@pytest.mark.parametrize("change", [{"epochs": 11}, {"lr": 0.002}, {"batch_size": 5}, {"checkpoint_selection": "best_validation"}, {"corpus_kind": "else"}, {"corpus_kind": []}, {"corpus_kind": "prepared_coco"}, {"class_names": ["x" * 41]}])
def test_pilot_settings_out_of_bounds(change):
    with pytest.raises(Refused):
        settings.checked(PILOT | change, settings.pilot(FILES))


def test_all_faults_are_named_at_once():
    bad = {k: v for k, v in TRAINING.items() if k != "seed"} | {"lr": 5, "typo": 1}
    with pytest.raises(Refused, match=r"unknown.*typo.*missing.*seed.*out of bounds.*lr"):
        settings.checked(bad, settings.training(["manifest.json"]))
    with pytest.raises(Refused, match="no table"):
        settings.checked([], settings.EXTENSION)


def test_extensions_are_bounded_by_their_parent():
    plan = {"schema_version": 1, "parent_report_sha256": "b" * 64, "parent_state_sha256": "c" * 64, "target_epochs": 5}
    parent = {"status": "completed", "config": TRAINING}
    made = settings.extended(plan, parent, "b" * 64, {"manifest.json": PIN})
    assert made["epochs"] == 4 and made["continuation_checkpoint_sha256"] == "c" * 64
    for bad, report, corpus, run in ((plan, "d" * 64, {"manifest.json": PIN}, parent), (plan, "b" * 64, {"manifest.json": "0"}, parent), (plan | {"target_epochs": 3}, "b" * 64, {"manifest.json": PIN}, parent), (plan, "b" * 64, {"manifest.json": PIN}, parent | {"status": "failed"}), (plan | {"target_epochs": 10}, "b" * 64, {"manifest.json": PIN}, {"status": "completed", "config": TRAINING | {"epochs": 1}})):
        with pytest.raises(Refused):
            settings.extended(bad, run, report, corpus)
