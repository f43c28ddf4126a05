"""Raster analytics over PySpark: images as relations of pixels."""

from rastrel.operators.energy import control_point_terms, foldover_limit, ssim, ssim_cost, ssim_similarity, total_energy
from rastrel.operators.graph import edge_costs, inside_polygons, livewire
from rastrel.operators.lines import convolve, fir, gaussian_blur, ifir, recursive_filter, scale
from rastrel.operators.matching import Settings, match
from rastrel.operators.render import composited, halfway, morph_frames
from rastrel.operators.resample import area_average, build_pyramid, downsample_cells, sample, upsample, upsample_field, warp
from rastrel.operators.solvers import coarse_solve, extended_canvas, filled_margin, jacobian_average, path_system, quadratic_path
from rastrel.session import session
from rastrel.sources.images import read_images, save, save_frames
from rastrel.sources.project import Project, read_project, write_project
from rastrel.sources.reports import Metrics, export_field

__all__ = [
    "Metrics", "Project", "Settings", "area_average", "build_pyramid", "coarse_solve", "composited", "control_point_terms", "convolve", "downsample_cells", "edge_costs",
    "export_field", "extended_canvas", "filled_margin", "fir", "foldover_limit", "gaussian_blur", "halfway", "ifir", "inside_polygons", "jacobian_average", "livewire", "match",
    "morph_frames", "path_system", "quadratic_path", "read_images", "read_project", "recursive_filter", "sample", "save", "save_frames", "scale", "session", "ssim", "ssim_cost",
    "ssim_similarity", "total_energy", "upsample", "upsample_field", "warp", "write_project",
]
