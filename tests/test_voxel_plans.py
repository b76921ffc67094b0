"""Voxels are dealt to tasks by patient once, before they are spread; neither the driver nor a shuffle gets them again."""

from __future__ import annotations

import re

import pytest

from voxcohort.plans import queries_voxels as qv
from voxcohort.plans import registry

SF = "/root/testdata/sf0.001"
#: Query: the most exchanges beside the one of patients (of counted values, or of voxels where they change places), and of broadcasts (a row for a volume).
MOST = {
    "capsule": (2, 0),  # F1
    "invasion_profile": (5, 0),  # F3
    "lesion_reference": (2, 0),  # F4
    "lesion_reference_liver": (2, 0),  # F5
    "rim_core": (3, 0),  # F6
    "robustness_per_patient": (4, 0),  # F7
    "angular_heterogeneity": (0, 0),  # F8
    "enhancement": (0, 0),  # F9
    "distances_by_plane": (1, 1),  # F11
    "resample_linear": (2, 1),  # F13
    "resample_nearest": (2, 1),  # F14
    "with_masks": (3, 4),  # F15
    "peritumoral": (3, 0),  # F19
    "assign_bands": (2, 0),  # F20
    "join_bands": (2, 1),  # F21
    "signed_distances_all": (0, 0),  # F22
    "necrosis": (2, 0),  # F23
    "radial_profile": (3, 0),  # F24
    "radial_zone": (2, 0),  # F25
    "multifocality": (3, 0),  # F26
    "mask_perturbation": (0, 0),  # F27
}


@pytest.mark.parametrize("name", MOST)
def test_no_voxels_are_broadcast_or_shuffled_again(spark, monkeypatch, name):
    monkeypatch.setattr(qv, "PATIENTS", 2, raising=False)
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in re.findall(r"Exchange hashpartitioning.*", plan) if "REPARTITION_BY_NUM" not in x]
    most, broadcasts = MOST[name]
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin" not in plan
    assert (len(exchanges) <= most and plan.count("BroadcastExchange") <= broadcasts), (len(exchanges), plan.count("BroadcastExchange"))


def test_manifest_broadcasts_no_names(spark):  # F17
    plan = registry.QUERIES["volume_manifest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
