"""Project documents: image and mask names, weights, schedules and control points, layer by layer, as XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

MAX_LAYERS = 5
# How the boundary is written.
BOUNDARIES = ("none", "corner", "border")


@dataclass(frozen=True)
class Layer:
    """points: (lx, ly, rx, ry) in 0..1. ssim_clamp is written as one less it."""

    mask1: str = ""
    mask2: str = ""
    w_ssim: float = 1.0
    w_tps: float = 0.001
    w_ui: float = 100.0
    ssim_clamp: float = 0.0
    boundary: str = "none"
    max_iter: int = 2000
    drop: float = 2.0
    eps: float = 0.01
    start_res: int = 8
    points: tuple[tuple[float, float, float, float], ...] = ()


@dataclass(frozen=True)
class Project:
    image1: str = ""
    image2: str = ""
    layers: tuple[Layer, ...] = field(default_factory=lambda: (Layer(),))


def _numbers(text: str | None) -> list[float]:
    return [float(x) for x in (text or "").split()]


def parse(text: str) -> Project:
    """A project from XML; what is missing has its default. Unequal lists of points, an unknown boundary or a wrong
    number of layers raise ValueError."""
    root = ET.fromstring(text)
    if root.tag != "project":
        root = root.find(".//project") or root
    images, layers = root.find("images"), root.find("layers")
    count = int(layers.get("num", "1")) if layers is not None else 0
    if not 1 <= count <= MAX_LAYERS:
        raise ValueError(f"a project has 1 to {MAX_LAYERS} layers")
    out = []
    for k in range(count):
        node = layers.find(f"l{k}")

        def get(path: str, name: str, default, node=node):
            at = node.find(path) if node is not None else None
            value = at.get(name) if at is not None else None
            return default if value is None else type(default)(value)

        left, right = (_numbers(get("parameters/points", n, "")) for n in ("image1", "image2"))
        if len(left) != len(right) or len(left) % 2:
            raise ValueError("both images need equally many points")
        lock = get("parameters/boundary", "lock", 0)
        if not 0 <= lock < len(BOUNDARIES):
            raise ValueError(f"no boundary {lock}")
        w, d = "parameters/weight", "parameters/debug"
        points = tuple((left[i], left[i + 1], right[i], right[i + 1]) for i in range(0, len(left), 2))
        out.append(Layer(
            get("masks", "mask1", ""), get("masks", "mask2", ""), get(w, "ssim", 1.0), get(w, "tps", 0.001), get(w, "ui", 100.0), 1 - get(w, "ssimclamp", 1.0),
            BOUNDARIES[lock], get(d, "iternum", 2000), get(d, "dropfactor", 2.0), get(d, "eps", 0.01), get(d, "startres", 8), points,
        ))
    return Project(images.get("image1", "") if images is not None else "", images.get("image2", "") if images is not None else "", tuple(out))


def write(project: Project) -> str:
    """The XML of a project."""
    root = ET.Element("project")
    ET.SubElement(root, "images", image1=project.image1, image2=project.image2)
    layers = ET.SubElement(root, "layers", num=str(len(project.layers)))
    for k, layer in enumerate(project.layers):
        node = ET.SubElement(layers, f"l{k}")
        ET.SubElement(node, "masks", mask1=layer.mask1, mask2=layer.mask2)
        p = ET.SubElement(node, "parameters")
        ET.SubElement(p, "weight", ssim=f"{layer.w_ssim:f}", tps=f"{layer.w_tps:f}", ui=f"{layer.w_ui:f}", ssimclamp=f"{1 - layer.ssim_clamp:f}")
        ET.SubElement(p, "points", image1=" ".join(f"{v:f}" for q in layer.points for v in q[:2]), image2=" ".join(f"{v:f}" for q in layer.points for v in q[2:]))
        ET.SubElement(p, "boundary", lock=str(BOUNDARIES.index(layer.boundary)))
        ET.SubElement(p, "debug", iternum=str(layer.max_iter), dropfactor=f"{layer.drop:f}", eps=f"{layer.eps:f}", startres=str(layer.start_res))
    return ET.tostring(root, encoding="unicode")


def read_project(spark: SparkSession, path: str) -> Project:
    """A project document, from wherever Spark can read."""
    return parse("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_project(spark: SparkSession, project: Project, path: str) -> None:
    spark.createDataFrame([(write(project),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def control_points(spark: SparkSession, project: Project) -> DataFrame:
    """(layer, idx, lx, ly, rx, ry)."""
    rows = [(k, i, *p) for k, layer in enumerate(project.layers) for i, p in enumerate(layer.points)]
    return spark.createDataFrame(rows, "layer int, idx int, lx double, ly double, rx double, ry double")


def parameters(spark: SparkSession, project: Project) -> DataFrame:
    """One row for each layer."""
    names = "w_ssim w_tps w_ui ssim_clamp boundary max_iter drop eps start_res".split()
    kinds = "double double double double string int double double int".split()
    rows = [(k, *(getattr(layer, n) for n in names)) for k, layer in enumerate(project.layers)]
    return spark.createDataFrame(rows, "layer int, " + ", ".join(f"{n} {t}" for n, t in zip(names, kinds)))
