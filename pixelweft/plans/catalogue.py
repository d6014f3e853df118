"""The registered queries of the raster operators: each a small tree of operators over a raster of the tables.

A tree runs on Spark as nested plans and renders as one statement with a common table expression per node for DuckDB.
Results are put in a common form: whole numbers as BIGINT, others as DOUBLE rounded to six places.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import arrays as ar
from ..operators import bands as ba
from ..operators import brushes as br
from ..operators import clipping as cl
from ..operators import colour as co
from ..operators import create as cr
from ..operators import draw as dr
from ..operators import effects as ef
from ..operators import frames as fr
from ..operators import geometry as ge
from ..operators import icc as ic
from ..operators import local as lo
from ..operators import palette as pl
from ..operators import paths
from ..operators import paths as pa
from ..operators import pointwise as pw
from ..operators import pyramid as py
from ..operators import regions as rg
from ..operators import stencil as st
from ..operators import strokes as sk
from ..sources import icc as profiles
from ..sources.rasters import raster, raster_sql
from . import whole_sql
from .sqlop import Operator, operator


@dataclass(frozen=True)
class Node:
    op: Operator | str
    inputs: tuple = ()
    how: dict = field(default_factory=dict)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if isinstance(self.op, str):
            return raster(spark, sf_dir, self.op)
        return self.op(*(n.frame(spark, sf_dir) for n in self.inputs), spark=spark, **self.how)

    def tables(self, named: list[tuple[str, str]]) -> str:
        """Append this node's table expressions; returns its name."""
        text = raster_sql(self.op) if isinstance(self.op, str) else self.op.sql(*(n.tables(named) for n in self.inputs), **self.how)
        for name, other in named:
            if other == text:
                return name
        named.append((f"s{len(named)}", text))
        return named[-1][0]


def of(op, /, *inputs, **how) -> Node:
    return Node(op, tuple(n if isinstance(n, Node) else Node(n) for n in inputs), how)


@operator(1)
def _with_alpha(d, r):
    """A fourth band that varies with place and value, 0 and 255 among it."""
    a = "CASE WHEN x % 5 = 0 THEN 0e0 WHEN x % 5 = 1 THEN 255e0 ELSE (v * 7 + x * 13) % 256 END"
    return f"SELECT image_id, x, y, band, v FROM {r} a UNION ALL SELECT image_id, x, y, 3 AS band, {a} AS v FROM {r} b WHERE band = 0"


@operator(1)
def _few_levels(d, r, levels: int = 4):
    return f"SELECT image_id, x, y, band, floor(v * {levels} / 256e0) AS v FROM {r}"


@operator(1)
def _corner(d, r, width: int = 4, height: int = 4):
    return f"SELECT image_id, x, y, band, v FROM {r} WHERE x < {width} AND y < {height}"


@operator(1)
def _next(d, r, images: int = 5):
    """Each image under the number of the one before it, so that all are paired with their successors."""
    return f"SELECT CAST((image_id + {images - 1}) % {images} AS INT) AS image_id, x, y, band, v FROM {r}"


@operator(1)
def _even(d, r):
    """Zeros among the pixels, by place."""
    return f"SELECT image_id, x, y, band, CASE WHEN (x + y + image_id) % 3 = 0 THEN v ELSE 0e0 END AS v FROM {r}"


@operator(1)
def _ramp_lut(d, r):
    return f"SELECT b.band, s.idx, CAST((s.idx * 3 + b.band * 50) % 256 AS DOUBLE) AS val FROM (SELECT DISTINCT band FROM {r}) b CROSS JOIN {d.series(0, 256, 'idx')} s"


@operator(1)
def _swirl(d, r):
    """Places to sample from, some outside."""
    return f"SELECT image_id, x, y, x * 9e-1 + y * 5e-2 - 5e-1 AS sx, y * 1.02e0 - x * 25e-2 AS sy FROM {r} WHERE band = 0"


@operator(1)
def _beside(d, r):
    """Each polygon moved, under the number of the one before it."""
    return f"SELECT path_id - 1 AS path_id, seq, x + 95e-1 AS x, y - 425e-2 AS y FROM {r} WHERE path_id > 0"


A, B = of("rgb"), of(_next, "rgb")
RGBA = of(_with_alpha, "rgb")
RGBA_A, RGBA_B = RGBA, of(_next, RGBA)
GREY0, GREY1 = of("stack"), of(_next, "stack")
MASK = of(pw.threshold, "grey", value=150)
MASK0 = of(pw.threshold, GREY0, value=140)
LAB_A, LAB_B, XYZ_ = of(co.to_lab, A), of(co.to_lab, B), of(co.to_xyz, "rgb")
PEL = "image_id:i x:i y:i band:i v"
HIST = "image_id:i band:i bin:i n:i"

QUERIES: dict[str, tuple[Node, str]] = {}


def _add(name: str, node: Node, form: str = PEL) -> None:
    QUERIES[name] = node, form


def _register() -> None:
    for f in pw.MATH:
        _add(f"math_{f}", of(pw.math_op, "rgb", function=f, operand=1.5))
        if f not in ("log", "log10", "sqrt", "pow"):
            _add(f"math_{f}_float", of(pw.math_op, "float", function=f, real=True))
    for f in ("pow", "wop", "atan2"):
        _add(f"math2_{f}", of(pw.math2, of(pw.linear, A, a=(0.01,), b=(0.5,), real=True), of(pw.linear, B, a=(0.01,), b=(0.5,), real=True), function=f))
    _add("invert", of(pw.invert, "rgb"))
    _add("invert_float", of(pw.invert, "float", real=True))
    _add("binary_invert", of(pw.invert, MASK))
    _add("linear", of(pw.linear, "rgb", a=(1.5, 0.7, 1.1), b=(-20, 10, 3.3)))
    _add("linear_const", of(pw.linear, "rgb", a=(1.25,), b=(7.5,)))
    _add("linear_float", of(pw.linear, "float", a=(2.0,), b=(-0.25,), real=True))
    for op in (pw.add, pw.subtract, pw.multiply, pw.divide):
        _add(op.__name__, of(op, A, of(_even, B) if op is pw.divide else B))
        _add(f"{op.__name__}_float", of(op, A, of(_even, B) if op is pw.divide else B, real=True))
    _add("remainder", of(pw.remainder, A, of(_even, B)))
    for op in (pw.sum_images, pw.min_image, pw.max_image):
        _add(op.__name__, of(op, "rgb"))
    for f in ("and", "or", "xor", "lshift", "rshift"):
        _add(f"{f}_const", of(pw.boolean_const, "rgb", op=f, c=(2, 77, 3)))
        _add(f"{f}_images", of(pw.boolean, A, B, op=f))
    for f in pw.RELATIONS:
        _add(f"{f}_const", of(pw.relational_const, "rgb", op=f, c=(128, 100, 160)))
        _add(f"{f}_images", of(pw.relational, A, B, op=f))
    _add("clamp", of(pw.clamp, "rgb", low=60, high=180))
    _add("threshold", of(pw.threshold, "rgb", value=130))
    _add("ifthenelse", of(pw.ifthenelse, of(_even, A), A, B))
    _add("switch", of(pw.switch, of(_even, "rgb")))
    _add("case", of(pw.case, of(_few_levels, A, levels=6), "rgb"))
    _add("cast_uchar", of(pw.cast_uchar, of(pw.linear, "float", a=(700.0,), b=(100.0,), real=True)))
    _add("cast_float", of(pw.cast_float, "rgb"))
    _add("scale", of(pw.scale, "rgb"))
    _add("scale_log", of(pw.scale, "rgb", log=True))
    _add("maplut", of(pw.maplut, "rgb", of(_ramp_lut, "rgb")))
    _add("falsecolor", of(pw.falsecolor, "grey"))

    _add("extract_band", of(ba.extract_band, "rgb", band=1, n=2))
    _add("bandjoin", of(ba.bandjoin, A, B))
    _add("bandjoin_const", of(ba.bandjoin_const, "rgb", c=(7, 300)))
    _add("bandmean", of(ba.bandmean, "rgb"))
    _add("bandmean_float", of(ba.bandmean, "rgb", real=True))
    for f in ("and", "or", "xor"):
        _add(f"bandbool_{f}", of(ba.bandbool, "rgb", op=f))
    _add("bandrank", of(ba.bandrank, "rgb"))
    _add("bandrank_min", of(ba.bandrank, "rgb", index=0))
    _add("bandfold", of(ba.bandfold, "rgb", factor=7))
    _add("bandunfold", of(ba.bandunfold, "rgb", factor=3))
    _add("add_alpha", of(ba.add_alpha, "rgb", alpha=200))
    _add("opacity", of(ba.opacity, RGBA, amount=0.4))
    _add("premultiply", of(ba.premultiply, RGBA))
    _add("unpremultiply", of(ba.unpremultiply, RGBA))
    _add("flatten", of(ba.flatten, RGBA, background=(10, 200, 90)))
    _add("background_color", of(ba.background_color, RGBA, background=(1, 2, 3)))
    for op in ("to_l8", "to_la16", "to_rgb24", "to_rgba32", "swap_rb", "to_argb"):
        _add(op, of(getattr(ba, op), RGBA, bands=4))

    for op in (co.recomb, co.saturate, co.greyscale, co.hue, co.sepia, co.to_grey, co.to_cmyk, co.to_scrgb, co.to_xyz, co.to_lab, co.srgb2hsv):
        _add(op.__name__, of(op, "rgb"))
    _add("color_matrix", of(co.color_matrix, RGBA))
    _add("brightness", of(co.brightness, "rgb"))
    _add("contrast", of(co.contrast, "rgb"))
    _add("gamma", of(co.gamma, "rgb"))
    _add("linearize", of(co.linearize, "rgb"))
    _add("delinearize", of(co.delinearize, "rgb"))
    _add("xyz2lab", of(co.xyz2lab, XYZ_))
    lab = of(co.xyz2lab, XYZ_)
    for op in (co.lab2xyz, co.lab2lch, co.lab2din99, co.lab2labs):
        _add(op.__name__, of(op, lab))
    _add("lch2lab", of(co.lch2lab, of(co.lab2lch, lab)))
    _add("din992lab", of(co.din992lab, of(co.lab2din99, lab)))
    _add("labs2lab", of(co.labs2lab, of(co.lab2labs, lab)))
    _add("xyz2yxy", of(co.xyz2yxy, XYZ_))
    _add("yxy2xyz", of(co.yxy2xyz, of(co.xyz2yxy, XYZ_)))
    ok = of(co.xyz2oklab, XYZ_)
    _add("xyz2oklab", ok)
    _add("oklab2xyz", of(co.oklab2xyz, ok))
    _add("oklab2oklch", of(co.oklab2oklch, ok))
    _add("oklch2oklab", of(co.oklch2oklab, of(co.oklab2oklch, ok)))
    _add("scrgb2xyz", of(co.scrgb2xyz, of(co.to_scrgb, "rgb")))
    _add("xyz2scrgb", of(co.xyz2scrgb, XYZ_))
    _add("hsv2srgb", of(co.hsv2srgb, of(co.srgb2hsv, "rgb")))
    _add("cmyk2xyz", of(co.cmyk2xyz, of(co.to_cmyk, "rgb")))
    _add("xyz2cmyk", of(co.xyz2cmyk, XYZ_))
    for op in (co.de76, co.de2000, co.decmc):
        _add(op.__name__, of(op, LAB_A, LAB_B))
    _add("dither_bayer4", of(co.dither_bayer, "rgb", levels=4, size=4))
    _add("dither_bayer8", of(co.dither_bayer, "grey", levels=2, size=8))

    for op in (co.kodachrome, co.lomograph, co.lightness):
        _add(op.__name__, of(op, "rgb"))
    for m in co.COLOR_BLINDNESS:
        _add(f"color_blindness_{m}", of(co.color_blindness, "rgb", mode=m))
    _add("lab2labq", of(co.lab2labq, lab))
    _add("labq2lab", of(co.labq2lab, of(co.lab2labq, lab)))

    _add("stats", of(an.stats, "bag"), "image_id:i band:i lo hi total squares mean deviation")
    for name, op in (("avg", an.avg), ("min", an.minimum), ("max", an.maximum), ("deviate", an.deviate)):
        _add(name, of(op, "rgb"), "image_id:i band:i v")
    _add("hist_find", of(an.hist_find, "bag", bands=3), HIST)
    _add("hist_cum", of(an.hist_cum, of(an.hist_find, "rgb", bands=3)), HIST)
    _add("hist_norm", of(an.hist_norm, of(an.hist_cum, of(an.hist_find, "rgb", bands=3))), HIST)
    _add("hist_equal", of(an.hist_equal, "grey"))
    _add("hist_match", of(an.hist_match, A, of(pw.linear, B, a=(0.5,), b=(20.0,)), bands=3))
    _add("hist_entropy", of(an.hist_entropy, "bag"), "image_id:i band:i entropy")
    for f in ("sum", "mean", "min", "max"):
        _add(f"hist_find_indexed_{f}", of(an.hist_find_indexed, A, of(_few_levels, GREY0, levels=9), reduction=f), "image_id:i band:i bin:i v")
    _add("hist_find_ndim", of(an.hist_find_ndim, "rgb"), "i:i j:i k:i n:i")
    _add("hist_plot", of(an.hist_plot, of(an.hist_find, "grey"), height=64), PEL)
    _add("percent", of(an.percent, "bag", share=60), "image_id:i v")
    _add("project", of(an.project, "rgb"), "image_id:i band:i axis:s place:i v")
    _add("profile", of(an.profile, of(_even, "rgb")), "image_id:i axis:s place:i v")
    _add("find_trim", of(an.find_trim, "rgb", threshold=40), "image_id:i left_:i top_:i width:i height:i")
    _add("countlines", of(an.countlines, "rgb"), "image_id:i band:i v")
    _add("countlines_vertical", of(an.countlines, "rgb", vertical=True), "image_id:i band:i v")
    _add("getpoint", of(an.getpoint, "rgb"), "image_id:i band:i v")
    _add("measure", of(an.measure, "rgb"), "image_id:i i:i j:i band:i v")
    _add("hough_line", of(an.hough_line, MASK0), "image_id:i theta:i rho:i n:i")
    _add("hough_circle", of(an.hough_circle, MASK0), "image_id:i radius:i x:i y:i n:i")
    re, im = of(pw.linear, GREY0, a=(1.0,), b=(-128.0,), real=True), of(pw.linear, GREY1, a=(1.0,), b=(-100.5,), real=True)
    z = of(an.complex_form, re, im)
    _add("complex_form", z, "image_id:i x:i y:i band:i re im")
    for f in ("polar", "rect", "conj"):
        _add(f"complex_{f}", of(an.complex_op, of(an.complex_op, z, op="polar") if f == "rect" else z, op=f), "image_id:i x:i y:i band:i re im")
    for f in ("real", "imag", "magnitude", "phase"):
        _add(f"complex_get_{f}", of(an.complex_get, z, mode=f))
    _add("cross_phase", of(an.cross_phase, z, of(an.complex_form, im, re)))

    _add("extract_area", of(ge.extract_area, "rgb"))
    _add("flip_horizontal", of(ge.flip, "rgb"))
    _add("flip_vertical", of(ge.flip, "rgb", vertical=True))
    for a in (90, 180, 270):
        _add(f"rotate_{a}", of(ge.rotate90, "rgb", angle=a))
    _add("rot45", of(ge.rot45, "rgb"))
    _add("auto_orient", of(ge.auto_orient, "rgb", orientation=7))
    _add("shrink", of(ge.shrink, "rgb"))
    _add("zoom", of(ge.zoom, "rgb"))
    _add("pixelate", of(ge.pixelate, "rgb"))
    _add("replicate", of(ge.replicate, "rgb"))
    _add("grid", of(ge.grid, "rgb"))
    _add("wrap", of(ge.wrap, "rgb"))
    for e in ("black", "white", "background", "copy", "repeat", "mirror"):
        _add(f"embed_{e}", of(ge.embed, "rgb", extend=e, background=(9, 8, 7)))
    _add("affine", of(ge.affine, A))
    _add("affine_nearest", of(ge.affine, A, nearest=True))
    _add("mapim", of(ge.mapim, A, of(_swirl, A)))
    _add("arrayjoin", of(ge.arrayjoin, "rgb"))
    _add("join_horizontal", of(ge.join_images, A, B))
    _add("join_vertical", of(ge.join_images, A, B, vertical=True, shim=0))
    _add("insert", of(ge.insert, A, of(_corner, B)))
    _add("insert_expand", of(ge.insert_expand, A, B))
    _add("vignette", of(ge.vignette, "rgb"))

    for op in (ge.similarity, ge.skew, ge.quadratic, ge.resize, ge.thumbnail):
        _add(op.__name__, of(op, A))
    for k in st.SUPPORT:
        _add(f"resize_{k}", of(ge.resize, "stack", scale=0.8, vscale=0.3, kernel=k))
    _add("bokeh_blur", of(st.bokeh_blur, "grey"))
    _add("sharpen", of(st.sharpen, "grey"))
    _add("page_bounds", of(an.page_bounds, "grey", bright=145, dark=110), "image_id:i axis:s first:i last:i")

    for op in (ef.oil_paint, ef.charcoal, ef.sketch, ef.polaroid, ef.rotate):
        _add(op.__name__, of(op, "rgb"))
    skews = of(ef.detect_skew, of(ef.analysis_copy, "rgb"))
    _add("detect_skew", skews, "image_id:i degrees")
    _add("deskew", of(ef.deskew, "rgb", skews))
    _add("auto_crop", of(ef.auto_crop, "grey", bright=145, dark=110))
    _add("edge_compass", of(ef.edge, "grey", method="compass"))
    _add("draw_line", of(dr.draw_line, "rgb"))
    for op in (pa.fill_path, pa.fill_polygon, pa.fill_rectangle, pa.fill_circle, pa.stroke_line):
        _add(op.__name__, of(op, "rgb"))
    _add("fill_path_hard", of(pa.fill_path, "rgb", antialiased=False))
    for op in (sk.stroke_path, sk.stroke_rectangle, sk.stroke_circle, sk.stroke_polygon):
        _add(op.__name__, of(op, "rgb"))
    _add("stroke_path_miter", of(sk.stroke_path, "rgb", pen=sk.Pen(4.0, "square", "miter"), antialiased=False))
    _add("stroke_path_dashed", of(sk.stroke_path, "rgb", pen=sk.Pen(3.0, "round", "bevel", dashes=(7.0, 2.5), dash_offset=-3.0)))
    for join in ("bevel", "miter", "round"):
        rings = of(sk.stroke_outlines, "polylines", pen=sk.Pen(1.5, "round" if join == "round" else "square", join))
        _add(f"stroke_outlines_{join}", rings, "path_id:i part:i ring:i seq:i x y")
        _add(f"stroke_areas_{join}", of(sk.ring_areas, rings), "path_id:i part:i ring:i area")
    _add("stroke_outlines_dashed", of(sk.stroke_outlines, "polylines", pen=sk.Pen(1.0, dashes=(9.0, 4.0, 2.0), dash_offset=5.0)), "path_id:i part:i ring:i seq:i x y")
    shape = paths.circle(10.0, 40.0, 9.5)
    for name, brush in (
        ("solid", br.solid((250, 10, 10))), ("linear", br.linear_gradient(2, 20, 18, 70, (255, 0, 10), (0, 200, 90))), ("radial", br.radial_gradient(9, 38, 8, (255, 255, 0), (10, 0, 120))),
        ("path_gradient", br.path_gradient(((3, 32), (17, 33), (10, 50)), ((255, 0, 0), (0, 255, 0), (0, 0, 255)))),
    ):
        _add(f"fill_{name}", of(br.fill, "rgb", brush=brush, path=shape))
        _add(f"fill_whole_{name}", of(br.fill, "rgb", brush=brush))
    for tiling in ("clamp", "repeat", "mirror"):
        _add(f"fill_image_{tiling}", of(br.fill_image, A, of(_corner, B, width=7, height=9), path=shape, offset=(4, -5), tiling=tiling))
    for p, t in (("bt2020", "pq"), ("bt2020", "hlg"), ("bt2020", "bt2020"), ("bt709", "linear"), ("bt709", "bt709")):
        _add(f"cicp2scrgb_{p}_{t}", of(co.cicp2scrgb, "rgb", primaries=p, transfer=t))
    page = of(ef.analysis_copy, "rgb", most=1000)
    _add("detect_upright", of(an.detect_upright, page), "image_id:i signal")
    _add("detect_upright_turned", of(an.detect_upright, of(ge.rotate90, page, angle=180)), "image_id:i signal")
    _add("is_upside_down", of(an.is_upside_down, page), "image_id:i v:i")
    for f in cl.KEEP:
        _add(f"path_{f}_area", of(cl.boolean_areas, "stars", of(_beside, "stars"), op=f), "path_id:i area")
    for f in pw.FORMATS:
        _add(f"cast_{f}" if f != "uchar" else "cast_format_uchar", of(pw.cast, of(pw.linear, "float", a=(1000.0,), b=(30.5,), real=True), format=f))
    _add("byteswap", of(pw.byteswap, of(pw.linear, "rgb", a=(200.0,), b=(3.0,), real=True)))
    _add("copy", of(pw.copy, "rgb"))
    _add("quantize", of(pl.quantize, "rgb"))
    _add("quantize_rgba", of(pl.quantize, RGBA, colors=40, bands=4))
    _add("quantize_palette", of(pl.quantize_palette, "rgb"))
    _add("hist_local", of(lo.hist_local, "rgb"))
    _add("black_white", of(co.saturate, "rgb", s=0.0))

    _add("conv_3x3", of(st.conv, "grey"))
    _add("conv1d", of(st.conv1d, "grey"))
    _add("conv1d_vertical", of(st.conv1d, "grey", vertical=True))
    _add("conv_sep", of(st.conv_sep, "grey"))
    _add("gauss_blur", of(st.gauss_blur, "grey"))
    _add("box_blur", of(st.box_blur, "grey"))
    _add("unsharp_mask", of(st.unsharp_mask, "grey"))
    _add("glow", of(st.glow, "grey"))
    _add("rank_3x3", of(st.rank, "grey", index=6))
    _add("median_3x3", of(st.rank, "grey"))
    for name, op in (("open", st.opening), ("close", st.closing)):
        _add(name, of(op, "grey"))
    for m in ("dilate", "erode"):
        _add(m, of(st.morph, "grey", method=m, mask=((0, 1, 0), (1, 1, 1), (0, 1, 0))))
    for op in (st.sobel, st.prewitt, st.kayyali, st.roberts, st.laplacian, st.compass, st.stdif):
        _add(op.__name__, of(op, "grey"))
    _add("fastcor", of(st.fastcor, GREY0, of(_corner, GREY1)))
    _add("spcor", of(st.spcor, GREY0, of(_corner, GREY1)))
    _add("resize1d", of(st.resize1d, "grey"))
    _add("resize1d_vertical", of(st.resize1d, GREY0, vertical=True, scale=1.6))

    for op in (cr.black, cr.xyz, cr.identity, cr.grey, cr.sines, cr.zone, cr.eye, cr.gaussmat, cr.logmat, cr.tonelut, cr.buildlut, cr.mask_fractal, cr.worley, cr.gaussnoise, cr.perlin, cr.fractsurf):
        _add(op.__name__, of(op))
    _add("grey_uchar", of(cr.grey, uchar=True))
    _add("invertlut", of(cr.invertlut, of(cr.grey, width=200, height=1)))
    for s in ("circle", "box", "rounded_box"):
        _add(f"sdf_{s}", of(cr.sdf, shape=s))
    for k in ("lowpass", "highpass", "ring", "band"):
        if k != "ring":
            _add(f"mask_ideal_{k}", of(cr.mask_ideal, kind=k))
        _add(f"mask_gaussian_{k}", of(cr.mask_gaussian, kind=k))
        _add(f"mask_butterworth_{k}", of(cr.mask_butterworth, kind=k))

    _add("draw_rect", of(dr.draw_rect, "rgb"))
    _add("draw_rect_outline", of(dr.draw_rect, "rgb", fill=False))
    _add("draw_circle", of(dr.draw_circle, "rgb"))
    _add("draw_circle_outline", of(dr.draw_circle, "rgb", fill=False))
    _add("clear", of(dr.clear, "rgb"))
    _add("draw_mask", of(dr.draw_mask, A, GREY0))
    _add("draw_smudge", of(dr.draw_smudge, "rgb"))
    for m in dr.PORTER_DUFF:
        _add(f"composite_{m}", of(dr.composite, RGBA_A, RGBA_B, mode=m, x=3, y=5))
    for m in dr.BLENDS:
        _add(f"blend_{m}", of(dr.composite_blend, A, B, mode=m, opacity=0.8))


_register()


def _form(form: str) -> str:
    out = []
    for column in form.split():
        name, _, kind = column.partition(":")
        out.append({"i": f"CAST({name} AS BIGINT) AS {name}", "s": name}.get(kind, f"round(CAST({name} AS DOUBLE), 6) + 0e0 AS {name}"))
    return ", ".join(out)


def _query(node: Node, form: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(f"SELECT {_form(form)} FROM {{t}}", t=node.frame(spark, sf_dir))

    return run


def _whole(kind: str, function):
    """A query of an operator on whole arrays; whole_sql has SQL for some, tests compare the others with brute force."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(raster(spark, sf_dir, kind) if kind else None, spark, sf_dir)

    return run


def _mask(spark, sf_dir):
    return pw.threshold(raster(spark, sf_dir, "stack"), value=150)


def _placed(df: DataFrame, *values: str, places: int = 6) -> DataFrame:
    """In the common form of the results of SQL."""
    keys = [f"CAST({k} AS BIGINT) AS {k}" for k in ("image_id", "x", "y", "band")]
    return df.selectExpr(*keys, *[f"round(CAST({v} AS DOUBLE), {places}) + 0e0 AS {v}" for v in values])


def _clipped(op):
    """A boolean of each vector's polygon and the next one's, as rings numbered by their first vertices."""
    def run(spark, sf_dir):
        stars = raster(spark, sf_dir, "stars")
        rings = cl.boolean(stars, _beside(stars), op)
        return rings.selectExpr(*(f"CAST({c} AS BIGINT) AS {c}" for c in ("path_id", "part", "ring", "seq")), *(f"round({c}, 6) + 0e0 AS {c}" for c in "xy"))

    return lambda r, spark, sf_dir: run(spark, sf_dir)


def _triangles(r, spark, sf_dir):
    """The polygon's area by its triangles, and how many these are."""
    found = cl.tessellate(raster(spark, sf_dir, "stars"))
    return found.groupBy("path_id").agg(F.count("*").alias("triangles"), F.round(F.sum(F.abs(F.expr("(x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)"))) / 2, 6).alias("area"))


def _held(r, spark, sf_dir):
    """How many triangles' interiors hold the middle of each grid place, which is the number of polygons over it."""
    stars = raster(spark, sf_dir, "stars")
    grid = spark.sql("SELECT a.id * 8 + 0.37123D AS x, b.id * 8 + 0.61877D AS y FROM range(9) a CROSS JOIN range(9) b")
    return cl.located(grid, cl.tessellate(stars)).groupBy("x", "y").agg(F.count("*").alias("n"))


def _pyramid(r, *_):
    """Of every tile of every level: its pixels and their sum."""
    return py.tiled(py.levels(r), tile=40, overlap=1).groupBy("image_id", "level", "col", "row", "band").agg(F.count("*").alias("pixels"), F.sum("v").alias("total")).selectExpr(
        *(f"CAST({c} AS BIGINT) AS {c}" for c in ("image_id", "level", "col", "row", "band", "pixels")), "CAST(total AS DOUBLE) AS total")


def _ink_profiles() -> tuple[bytes, bytes]:
    """Profiles of lookup tables by rule: of inks to Lab in a grid of 5, of Lab to three colours in one of 9."""
    import numpy as np

    def profile(tag, channels, grid, colours):
        at = [c.reshape(-1) / (grid - 1) for c in np.indices((grid,) * channels)]
        same = lambda n: np.tile([0.0, 1.0], (n, 1))
        return profiles.serialize(profiles.Profile("CMYK", "Lab ", tags={tag: profiles.lut_tag(profiles.Lut(same(channels), np.eye(3), grid, np.clip(np.stack(colours(*at), axis=1), 0, 1), same(3)))}))

    return (profile("A2B0", 4, 5, lambda c, m, y, k: ((1 - k) * (1 - 0.3 * c - 0.6 * m - 0.1 * y), 0.5 + 0.2 * (m - c) * (1 - k), 0.5 + 0.25 * (y - 0.5 * c - 0.5 * m) * (1 - k))),
            profile("B2A0", 3, 9, lambda l, a, b: (l + (a - 0.5), l - 0.5 * (a - 0.5) + 0.2 * (b - 0.5), l - (b - 0.5))))  # noqa: E741


#: Places and rules of the frames of an animation, by image.
FRAMES = """SELECT 0 AS anim, image_id AS frame, image_id, CAST((image_id * 3) % 7 AS INT) AS left_, CAST(image_id * 2 AS INT) AS top_,
  CASE image_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'previous' ELSE 'background' END AS dispose, CASE WHEN image_id % 2 = 0 THEN 'source' ELSE 'over' END AS blend
FROM (SELECT DISTINCT image_id FROM {t}) i"""


def _animation(r, spark, sf_dir):
    pixels = _with_alpha(r)
    shown = fr.composed(pixels, spark.sql(FRAMES, t=pixels))
    return shown.selectExpr(*(f"CAST({c} AS BIGINT) AS {c}" for c in ("anim", "frame", "x", "y", "band")), "v")


def _row_means(r, *_):
    """Frequencies along x other than 0 taken out, which leaves the means of rows."""
    import numpy as np

    return _placed(ar.freqmult(r, lambda h, w: np.tile(np.arange(w) == 0, (h, 1))), "v")


WHOLE = {
    "animation_frames": _whole("rgb", _animation),
    "freqmult": _whole("stack", _row_means),
    "icc_primaries": _whole("rgb", lambda r, *_: _placed(ic.icc_transform(r, profiles.srgb(), profiles.wide_gamut()), "v")),
    "icc_tables": _whole("rgb", lambda r, *_: _placed(ic.icc_transform(co.to_cmyk(r), *_ink_profiles()), "v")),
    "deep_zoom_tiles": _whole("rgb", _pyramid),
    **{f"path_{op}": _whole("", _clipped(op)) for op in (*cl.KEEP, "xor")},
    "path_triangles": _whole("", _triangles),
    "points_in_triangles": _whole("", _held),
    "fw_fft": _whole("stack", lambda r, *_: _placed(ar.fw_fft(r), "re", "im", places=whole_sql.PLACES)),
    "inv_fft": _whole("stack", lambda r, *_: _placed(ar.inv_fft(ar.fw_fft(r)), "v")),
    "spectrum": _whole("stack", lambda r, *_: _placed(ar.spectrum(r), "v")),
    "phasecor": _whole("stack", lambda r, *_: ar.phasecor(r, _next(r))),
    "label_regions": _whole("", lambda r, *at: _placed(rg.label_regions(_mask(*at)), "v")),
    "nearest": _whole("", lambda r, *at: _placed(rg.nearest(_mask(*at)), "v")),
    "draw_flood": _whole("", lambda r, *at: _placed(rg.draw_flood(_mask(*at), 5, 5, (99,)), "v")),
    "canny": _whole("grey", lambda r, *_: _placed(lo.canny(r), "v")),
    "quantize_grey": _whole("grey", lambda r, *_: _placed(pl.quantize_grey(r, 12), "v")),
    "entropy_crop": _whole("rgb", lambda r, *_: ar.entropy_crop(r, 12, 40)),
    **{f"dither_{m}": _whole("rgb", lambda r, *_, m=m: ar.dither(r, m)) for m in ar.DIFFUSION},
}


def queries() -> dict:
    return {name: _query(*what) for name, what in QUERIES.items()} | WHOLE


def oracle_sql() -> dict[str, str]:
    out = dict(whole_sql.SQL)
    rgba = _with_alpha.sql(raster_sql("rgb"))
    out["animation_frames"] = whole_sql.animation(rgba, FRAMES.replace("{t}", f"({rgba})"))
    for name, (node, form) in QUERIES.items():
        named: list[tuple[str, str]] = []
        last = node.tables(named)
        out[name] = f"WITH {', '.join(f'{n} AS MATERIALIZED ({t})' for n, t in named)} SELECT {_form(form)} FROM {last}"
    return out
