"""Parameters of the operators, with the defaults that the analyses use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    bbox_south: float = 8.0
    bbox_north: float = 14.0
    bbox_west: float = 76.0
    bbox_east: float = 81.5
    grid_degrees: float = 0.01
    min_grid_obs: int = 5
    zscore_spike: float = 2.0
    persistent_days: int = 3
    radii_m: tuple[int, ...] = (500, 1000, 2000, 5000, 10000)
    near_facility_m: float = 2000.0
    earth_radius_m: float = 6_371_000.0
    max_cloud_pct: float = 20.0
    min_valid_pct: float = 70.0
    window_days: int = 15
    tile_overlap: float = 0.0


DEFAULTS = Params()
