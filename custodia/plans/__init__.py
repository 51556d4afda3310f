"""Multi-step plans: governed execution and data movement."""

from custodia.plans.governed import governed_export, governed_query, run_governed
from custodia.plans.movement import (
    MovementError, MovementReport, fill_present, finish_governed, finish_movement, stage_governed,
    stage_governed_export, start_movement,
)

__all__ = [
    "governed_export", "governed_query", "run_governed", "MovementError", "MovementReport",
    "fill_present", "finish_governed", "finish_movement", "stage_governed",
    "stage_governed_export", "start_movement",
]
