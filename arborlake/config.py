"""Settings of a survey. Lengths are metres unless a name says otherwise."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from hashlib import sha1
from typing import Any


@dataclass(frozen=True)
class SurveyConfig:
    """Every setting that operators take; each is a literal in the plans built from it."""

    # Names and defaults are the published parameters of the method, which results depend on.
    # input and output
    las_path: str = "Forest.las"
    out_dir: str = "outputs"
    # isolated returns
    noise_voxel: float = 0.5
    noise_min_pts: int = 4
    # thinning
    ground_voxel: float = 0.10
    seg_voxel: float = 0.15
    stem_voxel: float = 0.01
    # cloth
    csf_cloth_res: float = 0.5
    csf_rigidness: int = 3
    csf_time_step: float = 0.65
    csf_iterations: int = 500
    csf_threshold: float = 0.15
    # terrain
    dtm_res: float = 0.25
    # stems
    stem_slice_lo: float = 0.60
    stem_slice_hi: float = 2.60
    stem_layer_thick: float = 0.20
    stem_layer_step: float = 0.20
    stem_dbscan_eps: float = 0.07
    stem_dbscan_min_pts: int = 12
    stem_link_dist: float = 0.12
    stem_link_radius_ratio: float = 1.8
    stem_min_layers: int = 4
    stem_min_diameter: float = 0.04
    stem_max_diameter: float = 1.50
    stem_max_rmse: float = 0.030
    stem_min_verticality: float = 0.80
    # growth
    veg_min_height: float = 0.30
    graph_k: int = 10
    graph_max_edge: float = 0.40
    graph_z_weight: float = 0.35
    # measures
    dbh_height: float = 1.30
    dbh_slice_thickness: float = 0.12
    dbh_fallback_heights: tuple[float, ...] = (1.30, 1.50, 1.00, 1.70)
    ransac_iters: int = 300
    ransac_tol: float = 0.02
    ransac_min_inlier_frac: float = 0.35
    height_percentile: float = 99.5
    min_tree_height: float = 2.0
    # other
    random_seed: int = 42
    # terrain details
    dtm_smooth_sigma: float = 1.0
    dtm_max_fill_dist: float = 3.0
    dtm_despike: float = 1.0
    dtm_despike_window: float = 5.0
    dtm_despike_passes: int = 2
    dtm_min_obs_density: float = 0.06
    csf_tol: float = 0.005
    csf_min_iterations: int = 20
    # stem details
    link_radius_slope: float = 0.35
    merge_distance: float = 0.30
    # tile of grid kernels, in cells, and the margin each tile sees of its neighbours where a step has no reach of its own;
    # results don't depend on these
    tile_cells: int = 512
    tile_margin: int = 96

    def dump(self) -> dict[str, Any]:
        return asdict(self)

    def terrain_key(self, *identity: object) -> str:
        """A short key of the input's identity and of all settings that change the terrain."""
        names = ("noise_voxel", "noise_min_pts", "ground_voxel", "dtm_res")
        own = [n for n in self.dump() if n in names or n.startswith(("csf_", "dtm_"))]
        parts = [*map(str, identity), *(f"{n}={getattr(self, n)}" for n in sorted(own))]
        return sha1("|".join(parts).encode()).hexdigest()[:16]


def from_values(values: dict[str, Any], base: SurveyConfig | None = None) -> SurveyConfig:
    """Take over known settings from loose values: unknown and null ones are left, types are coerced."""
    base = base or SurveyConfig()
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    taken: dict[str, Any] = {}
    for name, value in values.items():
        if value is None or name not in known:
            continue
        old = known[name]
        if isinstance(old, int):
            taken[name] = round(float(value))
        elif isinstance(old, float):
            taken[name] = float(value)
        else:
            taken[name] = type(old)(value)
    return replace(base, **taken)
