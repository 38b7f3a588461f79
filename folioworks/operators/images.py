"""Image measures and conditioning on pixels, as Arrow-batched functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STEPS = ("denoise", "deskew", "otsu", "rescale")
FAST_DROPS = ("denoise", "rescale")


def entropy_of(pixels: np.ndarray) -> float:
    counts = np.bincount(pixels.ravel(), minlength=256)
    p = counts[counts > 0] / max(1, pixels.size)
    return float(-(p * np.log2(p)).sum())


@F.pandas_udf(DoubleType())
def image_entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy of the grey levels of 8-bit pixels."""
    return data.map(lambda x: None if x is None else entropy_of(np.frombuffer(x, np.uint8)))


def otsu_threshold(pixels: np.ndarray) -> int:
    counts = np.bincount(pixels.ravel(), minlength=256).astype(float)
    w = np.cumsum(counts)
    m = np.cumsum(counts * np.arange(256))
    between = np.divide((m[-1] * w - m * w[-1]) ** 2, w * (w[-1] - w), out=np.zeros(256), where=(w > 0) & (w < w[-1]))
    return int(between.argmax())


def binarize(pixels: np.ndarray) -> tuple[np.ndarray, bool]:
    """Black on white by Otsu's threshold; unchanged if binary already."""
    if np.isin(pixels, (0, 255)).all():
        return pixels, False
    out = np.where(pixels > otsu_threshold(pixels), 255, 0).astype(np.uint8)
    return (255 - out if out.mean() < 127 else out), True


def denoise(pixels: np.ndarray) -> tuple[np.ndarray, bool]:
    """The median of 3 x 3 neighbours."""
    p = np.pad(pixels, 1, mode="edge")
    return np.median(np.stack([p[i : i + pixels.shape[0], j : j + pixels.shape[1]] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8), True


def rescale(pixels: np.ndarray, dpi: int = 72, target: int = 300) -> tuple[np.ndarray, bool]:
    """Bilinear, to the wanted resolution; skipped when near it, or for large images of unknown one."""
    if abs(dpi - target) <= 5 or dpi <= 72 and min(pixels.shape) >= 1500:
        return pixels, False
    h, w = (max(1, round(s * target / dpi)) for s in pixels.shape)
    y, x = np.linspace(0, pixels.shape[0] - 1, h), np.linspace(0, pixels.shape[1] - 1, w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, pixels.shape[0] - 1), np.minimum(x0 + 1, pixels.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    a = pixels[np.ix_(y0, x0)] * (1 - fy) * (1 - fx) + pixels[np.ix_(y1, x0)] * fy * (1 - fx)
    return np.round(a + pixels[np.ix_(y0, x1)] * (1 - fy) * fx + pixels[np.ix_(y1, x1)] * fy * fx).astype(np.uint8), True


def skew_angle(pixels: np.ndarray) -> float:
    """Degrees of the dark pixels' main axis; 0 for fewer than 100 of them."""
    y, x = np.nonzero(pixels <= otsu_threshold(pixels))
    if len(x) < 100:
        return 0.0
    values, vectors = np.linalg.eigh(np.cov(x, y))
    angle = float(np.degrees(np.arctan2(vectors[1, -1], vectors[0, -1])))
    return (angle + 90) % 180 - 90


def plan_steps(wanted: list[str] | str | None, auto_fix: bool = True, fast: bool = False) -> tuple[list[str], list[str]]:
    """Steps in their order, and warnings; Otsu wants denoising before it."""
    steps = list(STEPS) if wanted == "auto" else [s for s in STEPS if s in (wanted or [])]
    warnings = []
    if "otsu" in steps and "denoise" not in steps:
        if auto_fix:
            steps = [s for s in STEPS if s in (*steps, "denoise")]
        else:
            warnings.append("otsu without denoise")
    return [s for s in steps if not (fast and s in FAST_DROPS)], warnings


# ------------------------------------------------------------------ steps that act


def non_local_means(pixels: np.ndarray, strength: float = 10.0, patch: int = 7, search: int = 21) -> tuple[np.ndarray, bool]:
    """Each pixel as the mean of those around it, weighted by how alike their patches are; always applied."""
    p, s = patch // 2, search // 2
    x = np.pad(pixels.astype(np.float64), p + s, mode="reflect" if min(pixels.shape) > p + s else "edge")
    h, w = pixels.shape
    total, weight = np.zeros((h, w)), np.zeros((h, w))
    box = lambda a: (c := np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1))[patch:, patch:] - c[:-patch, patch:] - c[patch:, :-patch] + c[:-patch, :-patch]
    mid = x[s : s + h + 2 * p, s : s + w + 2 * p]
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            other = x[s + dy : s + dy + h + 2 * p, s + dx : s + dx + w + 2 * p]
            k = np.exp(-box((mid - other) ** 2) / (patch * patch) / strength**2)
            total += k * other[p : p + h, p : p + w]
            weight += k
    return np.clip(np.round(total / weight), 0, 255).astype(np.uint8), True


def least_box_angle(pixels: np.ndarray) -> float | None:
    """Degrees by which the least rectangle around the dark pixels is turned, in (-45, 45]; None for fewer than 100 of them."""
    y, x = np.nonzero(pixels <= otsu_threshold(pixels))
    if len(x) < 100:
        return None
    pts = np.unique(np.stack([x, y], axis=1), axis=0)

    def chain(points):
        out: list = []
        for q in points.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    hull = np.array(chain(pts) + chain(pts[::-1]), float)
    edges = np.roll(hull, -1, axis=0) - hull
    angles = np.arctan2(edges[:, 1], edges[:, 0])
    spin = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    along, across = hull @ spin.T, hull @ np.stack([-spin[:, 1], spin[:, 0]])
    sizes = np.ptp(along, axis=0) * np.ptp(across, axis=0)
    angle = float(np.degrees(angles[int(sizes.argmin())])) % 90
    return angle - 90 if angle > 45 else angle


def rotate(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about the middle (content turned by +a is straightened by a), cubic, edges repeated."""
    h, w = pixels.shape
    t = np.radians(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(np.float64)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(t) * (xx - cx) - np.sin(t) * (yy - cy) + cx
    sy = np.sin(t) * (xx - cx) + np.cos(t) * (yy - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0

    def weights(f):
        a = -0.75  # the usual cubic kernel
        d = [1 + f, f, 1 - f, 2 - f]
        near = lambda v: ((a + 2) * v - (a + 3)) * v * v + 1
        far = lambda v: ((a * v - 5 * a) * v + 8 * a) * v - 4 * a
        return [far(d[0]), near(d[1]), near(d[2]), far(d[3])]

    out = np.zeros((h, w))
    for j, wy in enumerate(weights(fy)):
        for i, wx in enumerate(weights(fx)):
            out += wy * wx * pixels[np.clip(y0 + j - 1, 0, h - 1), np.clip(x0 + i - 1, 0, w - 1)]
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def deskew(pixels: np.ndarray, severe_only: bool = False) -> tuple[np.ndarray, bool]:
    """Straightened by the angle of the least rectangle; left alone if that is small or there is little to see."""
    angle = least_box_angle(pixels)
    if angle is None or abs(angle) < (2.0 if severe_only else 0.5):
        return pixels, False
    return rotate(pixels, angle), True


#: name -> function from pixels to (pixels, whether it did anything)
REGISTRY = {"denoise": non_local_means, "deskew": deskew, "otsu": binarize, "rescale": rescale}


def normalized_steps(steps: list[str] | dict[str, dict] | str | None) -> dict[str, dict]:
    """Steps and their settings; names that the registry lacks are dropped, each is taken once, in the fixed order."""
    given = {s: {} for s in STEPS} if steps == "auto" else dict(steps) if isinstance(steps, dict) else {s: {} for s in steps or []}
    return {s: dict(given[s] or {}) for s in STEPS if s in given and s in REGISTRY}


def run_steps(pixels: np.ndarray, steps: dict[str, dict]) -> tuple[np.ndarray, list[str], list[str]]:
    """The pixels after all steps, which did something, and which didn't."""
    applied, skipped = [], []
    for name, settings in steps.items():
        pixels, did = REGISTRY[name](pixels, **settings)
        (applied if did else skipped).append(name)
    return pixels, applied, skipped


PREPARED = "height int, width int, pixels binary, applied array<string>, skipped array<string>, warnings array<string>, error string"


def prepare_for_ocr(frames, steps: list[str] | dict[str, dict] | str | None = "auto", auto_fix: bool = True, fast: bool = False, key: str = "file_path"):
    """Frames (key, page_number, height, width, grey pixels) conditioned page by page, by Arrow batches; a frame that fails keeps its row with the error."""
    wanted = normalized_steps(steps)
    names, warnings = plan_steps(list(wanted), auto_fix, fast)
    todo = {s: wanted.get(s, {}) for s in names}

    def run(batches):
        for f in batches:
            rows = []
            for k, page, h, w, data in zip(f[key], f["page_number"], f["height"], f["width"], f["pixels"]):
                try:
                    px, applied, skipped = run_steps(np.frombuffer(bytes(data), np.uint8).reshape(h, w), todo)
                    rows.append((k, page, *px.shape, px.tobytes(), applied, skipped, warnings, None))
                except Exception as e:  # the frame's own result
                    rows.append((k, page, h, w, None, [], [], warnings, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "page_number", *[x.split()[0] for x in PREPARED.split(", ")]])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "page_number", "height", "width", "pixels").mapInPandas(run, f"{key} {kind}, page_number int, {PREPARED}")


# ------------------------------------------------------------------ regions of a page's bitmap


def _boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (x0, y0, x1, y1) of the connected regions (8 neighbours) of a mask: runs of rows, joined by union-find."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.nonzero(edge == 1)
    _, z = np.nonzero(edge == -1)
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    heads = np.searchsorted(y, np.arange(h + 1))
    for r in range(1, h):
        i, j = heads[r - 1], heads[r]
        while i < heads[r] and j < heads[r + 1]:
            if a[i] <= z[j] and a[j] <= z[i]:
                root[find(int(j))] = find(int(i))
            if z[i] < z[j]:
                i += 1
            else:
                j += 1
    out: dict[int, list[int]] = {}
    for i in range(len(y)):
        b = out.setdefault(find(i), [w, h, 0, 0])
        b[0], b[1], b[2], b[3] = min(b[0], int(a[i])), min(b[1], int(y[i])), max(b[2], int(z[i])), max(b[3], int(y[i]) + 1)
    return [tuple(b) for b in out.values()]


def _mean(x: np.ndarray, size: int) -> np.ndarray:
    p = size // 2
    c = np.pad(np.pad(x.astype(np.float64), p, mode="edge"), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / (size * size)


def _grown(mask: np.ndarray, wide: int, tall: int) -> np.ndarray:
    for n, axis in ((wide, 1), (tall, 0)):
        out = mask.copy()
        for k in range(1, n // 2 + 1):
            out |= np.roll(mask, k, axis) | np.roll(mask, -k, axis)
        mask = out
    return mask


def overlap(a: tuple, b: tuple) -> float:
    wide, tall = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0, wide) * max(0, tall)
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return inter / max(1, size(a) + size(b) - inter)


def page_regions(pixels: np.ndarray, block: int = 11, step: float = 2.0, least: int = 50, variance: float = 500.0) -> tuple[list[tuple], list[tuple]]:
    """Boxes of text (dark against their surroundings, joined along lines) and of images (busy areas that no text region accounts for)."""
    dark = pixels < _mean(pixels, block) - step
    text = []
    for b in _boxes(_grown(_grown(dark, 9, 1), 1, 3)):
        part = pixels[b[1] : b[3], b[0] : b[2]]
        if part.size >= least and np.ptp(part) >= 30 and (b[3] - b[1]) < pixels.shape[0] * 0.15:
            text.append(b)
    x = pixels.astype(np.float64)
    busy = _mean(x * x, 15) - _mean(x, 15) ** 2 > variance
    image = [b for b in _boxes(busy) if (b[2] - b[0]) * (b[3] - b[1]) >= 0.01 * pixels.size and all(overlap(b, t) < 0.2 for t in text)]
    return text, image


VISION = "text_regions int, image_regions int, text_coverage double, image_coverage double, page_area double"


def vision_pages(frames, key: str = "file_path"):
    """Regions and their share of each page's area, for ``vision_rollup``."""

    def run(batches):
        for f in batches:
            rows = []
            for k, page, h, w, data in zip(f[key], f["page_number"], f["height"], f["width"], f["pixels"]):
                text, image = page_regions(np.frombuffer(bytes(data), np.uint8).reshape(h, w))
                share = lambda r, n=h * w: 100.0 * min(1.0, sum((b[2] - b[0]) * (b[3] - b[1]) for b in r) / max(1, n))
                rows.append((k, page, len(text), len(image), share(text), share(image), float(h * w)))
            yield pd.DataFrame(rows, columns=[key, "page_number", *[x.split()[0] for x in VISION.split(", ")]])

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(key, "page_number", "height", "width", "pixels").mapInPandas(run, f"{key} {kind}, page_number int, {VISION}")
