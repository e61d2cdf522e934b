"""Planar image operators.

An image is a struct of pf, width, height and planes (array of binary, 8 bits a sample). Kernels work on
Arrow batches, on all images of a batch that have one form at once (planes of shape images x lines x samples); what needs no neighbour pixels and is small (geometry, masks of lists) is in payload.py.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<pf:string,width:int,height:int,planes:array<binary>>"
#: Horizontal and vertical division of the chroma planes.
CHROMA = {"yuv420p": (2, 2), "yuv422p": (2, 1), "yuv444p": (1, 1), "yuva444p": (1, 1), "grey8": None, "rgb24p": (1, 1)}

Planes = list[np.ndarray]


def plane_shapes(pf: str, width: int, height: int) -> list[tuple[int, int]]:
    div = CHROMA[pf]
    if div is None:
        return [(height, width)]
    return [(height, width)] + [(-(-height // div[1]), -(-width // div[0]))] * 2 + [(height, width)] * (pf == "yuva444p")


def apply(df: DataFrame, column: str, kernel: Callable[[Planes, str], tuple[Planes, str]]) -> DataFrame:
    """kernel(planes, pf) -> (planes, pf) on every image of a column; null images stay null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield _stacked(frame.reset_index(drop=True), lambda f: kernel(planes_of(f), f["pf"].iloc[0]))

    work.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.pandas_udf(work, IMAGE)(column)))


def planes_of(frame: pd.DataFrame) -> Planes:
    """The planes of images of one form, each of shape images x lines x samples."""
    shapes = plane_shapes(frame["pf"].iloc[0], int(frame["width"].iloc[0]), int(frame["height"].iloc[0]))
    return [np.stack([np.frombuffer(p[k], np.uint8) for p in frame["planes"]]).reshape(-1, *s) for k, s in enumerate(shapes)]


def _stacked(frame: pd.DataFrame, made: Callable[[pd.DataFrame], tuple[Planes, str]], forms: tuple[str, ...] = ("pf", "width", "height"), most: int = 1 << 26) -> pd.DataFrame:
    """made of the rows of each form (in parts of bounded size), in the order of the rows; null where an image is."""
    out: list = [(None, None, None, None)] * len(frame)
    for _, at in frame[frame["planes"].notna()].groupby(list(forms)).groups.items():
        own = frame.loc[at]
        step = max(1, most // max(1, int(own["width"].iloc[0]) * int(own["height"].iloc[0])))
        for a in range(0, len(own), step):
            part = own.iloc[a : a + step]
            got, pf = made(part)
            raw = [np.ascontiguousarray(p, np.uint8) for p in got]
            h, w = got[0].shape[-2:]
            for k, i in enumerate(part.index):
                out[i] = (pf, w, h, [p[k].tobytes() for p in raw])
    return pd.DataFrame(out, columns=["pf", "width", "height", "planes"])


def _wide(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """A plane repeated to h lines of w samples."""
    dy, dx = -(-h // x.shape[-2]), -(-w // x.shape[-1])
    return x.repeat(dy, -2).repeat(dx, -1)[..., :h, :w]


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def chroma(u: int = 128, v: int = 128):
    """Chroma planes of one value (128: grey)."""
    return lambda p, pf: ([p[0], *(np.full_like(x, c) for x, c in zip(p[1:], (u, v), strict=False))], pf)


def _region(shape: tuple[int, int], whole: tuple[int, int], rect: tuple[float, float, float, float]) -> tuple[slice, slice]:
    """The lines and samples of a plane that lie in a rectangle given by shares of the image's size, cut down to whole samples."""
    (h, w), (own_h, own_w) = whole, shape
    dy, dx = -(-h // own_h), -(-w // own_w)
    x0, y0, x1, y1 = int(rect[0] * w), int(rect[1] * h), int(rect[0] * w) + int(rect[2] * w), int(rect[1] * h) + int(rect[3] * h)
    return slice(max(y0, 0) // dy, -(-max(y1, 0) // dy)), slice(max(x0, 0) // dx, -(-max(x1, 0) // dx))


def invert(planes: int = 7, rx: float = 0.0, ry: float = 0.0, rw: float = 1.0, rh: float = 1.0):
    """The planes of the bit mask inverted, inside a rectangle given by shares of width and height. An alpha plane isn't."""

    def kernel(p: Planes, pf: str):
        out = []
        for k, x in enumerate(p):
            x = x.copy()
            if planes >> k & 1 and k < 3:
                lines, samples = _region(x.shape[-2:], p[0].shape[-2:], (rx, ry, rw, rh))
                x[..., lines, samples] = 255 - x[..., lines, samples]
            out.append(x)
        return out, pf

    return kernel


def mono(cut_off: int = 128, chroma: int = 0):
    """Black under the limit, white from it on; chroma neutral, or as it is with chroma other than 0."""
    return lambda p, pf: ([np.where(p[0] < cut_off, 16, 235), *(x if chroma else np.full_like(x, 128) for x in p[1:3]), *p[3:]], pf)


def correction(contrast: float = 1.0, brightness: float = 0.0, hue: float = 0.0, saturation: float = 1.0):
    """Luma scaled from 0 by contrast, with brightness added; chroma turned by hue (degrees) and scaled by contrast and saturation.

    In whole numbers: factors are 255ths, products are shifted by 8 bits, so a factor of 1 takes 255/256; brightness, times 255, is added before
    that shift. Chroma lies around 127, and the second plane is computed from the first one's result.
    """
    scaled = lambda x: int(255 * x)
    by, plus, chroma_by = scaled(contrast), scaled(brightness), scaled(contrast * saturation)
    si, co = scaled(np.sin(np.pi * hue / 180)), scaled(np.cos(np.pi * hue / 180))
    turned = lambda x: _clip((x >> 8) * chroma_by // 256 + 127)

    def kernel(p: Planes, pf: str):
        y = _clip((p[0].astype(np.int64) * by + plus) >> 8)
        if len(p) < 3:
            return [y], pf
        u, v = (x.astype(np.int64) - 127 for x in p[1:3])
        new_u = turned(u * co + v * si)
        return [y, new_u, turned(v * co - (new_u.astype(np.int64) - 127) * si), *p[3:]], pf

    return kernel


def charcoal(scale: float = 1.5, mix: float = 0.0):
    """Edges of the luma drawn dark on light, in a border of black; mix: the share of the picture itself. Chroma stays.

    The strength is 1.5 * scale times the root (a whole number) of the squared gradients, within 16 to 235, taken from 251. The gradient from line to
    line takes its last term along the line below, as the one along lines does.
    """
    by, share = int(256 * scale), int(256 * mix)

    def kernel(p: Planes, pf: str):
        x = p[0].astype(np.int64)
        out = np.full(x.shape, 16, np.uint8)
        at = lambda dy, dx: x[..., 1 + dy : x.shape[-2] - 1 + dy, 1 + dx : x.shape[-1] - 1 + dx]
        if min(x.shape[-2:]) > 2:
            below = at(1, 1) - at(1, -1)
            down = at(1, -1) - at(-1, -1) + 2 * (at(1, 0) - at(-1, 0)) + below
            across = at(-1, 1) - at(-1, -1) + 2 * (at(0, 1) - at(0, -1)) + below
            root = np.floor(np.sqrt(down * down + across * across)).astype(np.int64)
            strength = np.clip((3 * root // 2 * by) >> 8, 16, 235)
            out[..., 1:-1, 1:-1] = ((256 - share) * (251 - strength) + share * at(0, 0)) >> 8
        return [out, *p[1:]], pf

    return kernel


def chroma_key(u: int = 145, v: int = 112, var: int = 4):
    """An alpha plane (grey8): 0 where both chroma samples are near the key, else the alpha that the picture has (yuva444p), or 255."""

    def kernel(p: Planes, pf: str):
        hit = (np.abs(p[1].astype(int) - u) <= var) & (np.abs(p[2].astype(int) - v) <= var)
        return [np.where(_wide(hit, *p[0].shape[-2:]), 0, p[3] if len(p) > 3 else 255)], "grey8"

    return kernel


def key_alpha(df: DataFrame, column: str, alpha: str, u: int = 145, v: int = 112, var: int = 4) -> DataFrame:
    """df with alpha, a column of grey8 images or nulls, set to 0 where the picture's chroma is near the key (see chroma_key).

    Where there is no alpha yet, or one of another size, the rest is opaque or the alpha rescaled. Null pictures leave it as it is.
    """

    def work(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for images, masks in batches:
            frame = images.reset_index(drop=True)
            masks = masks.reset_index(drop=True)

            def made(f: pd.DataFrame, masks: pd.DataFrame = masks) -> tuple[Planes, str]:
                keyed = chroma_key(u, v, var)(planes_of(f)[:3], "")[0][0]
                h, w = keyed.shape[-2:]
                for k, i in enumerate(f.index):
                    if masks["planes"][i] is not None:
                        own = np.frombuffer(masks["planes"][i][0], np.uint8).reshape(1, int(masks["height"][i]), int(masks["width"][i]))
                        own = own if own.shape[-2:] == (h, w) else rescale(w, h)([own], "grey8")[0][0]
                        keyed[k] = np.minimum(keyed[k], own[0])
                return [keyed], "grey8"

            yield _stacked(frame, made)

    work.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.DataFrame]], "return": Iterator[pd.DataFrame]}
    known = F.when(F.col(alpha).isNotNull(), F.col(alpha)).otherwise(F.lit(None).cast(IMAGE))
    return df.withColumn(alpha, F.when(F.col(column).isNotNull(), F.pandas_udf(work, IMAGE)(column, known)).otherwise(F.col(alpha)))


def rescale(width: int = 640, height: int = 360, bilinear: bool = True):
    """Another size, with the nearest or the two nearest samples each way."""

    def one(x: np.ndarray, w: int, h: int) -> np.ndarray:
        own_h, own_w = x.shape[-2:]
        ys, xs = (np.arange(h) + 0.5) * own_h / h - 0.5, (np.arange(w) + 0.5) * own_w / w - 0.5
        ys, xs = np.clip(ys, 0, own_h - 1), np.clip(xs, 0, own_w - 1)
        if not bilinear:
            return x[..., np.rint(ys).astype(int), :][..., np.rint(xs).astype(int)]
        y0, x0 = ys.astype(int), xs.astype(int)
        y1, x1 = np.minimum(y0 + 1, own_h - 1), np.minimum(x0 + 1, own_w - 1)
        fy, fx = (ys - y0)[:, None], xs - x0
        x = x.astype(float)
        line = lambda r: r[..., x0] * (1 - fx) + r[..., x1] * fx
        return _clip(line(x[..., y0, :]) * (1 - fy) + line(x[..., y1, :]) * fy + 0.5)

    return lambda p, pf: ([one(x, w, h) for x, (h, w) in zip(p, plane_shapes(pf, width, height), strict=False)], pf)


def distort(width: int, height: int, bilinear: bool = True):
    """Just this size, whatever the image's shape; an image of the size stays as it is."""
    other = rescale(width, height, bilinear)
    return lambda p, pf: (p, pf) if p[0].shape[-2:] == (height, width) else other(p, pf)


def crop(x: int, y: int, width: int, height: int):
    """A rectangle, its corner rounded down to whole chroma samples."""

    def kernel(p: Planes, pf: str):
        dx, dy = CHROMA[pf] or (1, 1)
        x0, y0 = x // dx * dx, y // dy * dy
        w, h = min(width, p[0].shape[-1] - x0), min(height, p[0].shape[-2] - y0)
        cut = [p[0][..., y0 : y0 + h, x0 : x0 + w]]
        return cut + [c[..., y0 // dy : y0 // dy + -(-h // dy), x0 // dx : x0 // dx + -(-w // dx)] for c in p[1:]], pf

    return kernel


def deinterlace(p: Planes, pf: str):
    """Odd lines are the mean of the lines around them."""
    out = []
    for x in p:
        y = x.copy()
        if x.shape[-2] > 2:
            n = len(range(1, x.shape[-2] - 1, 2))
            y[..., 1:-1:2, :] = ((x[..., 0:-2:2, :][..., :n, :].astype(int) + x[..., 2::2, :][..., :n, :] + 1) >> 1).astype(np.uint8)
        out.append(y)
    return out, pf


def swap_fields(p: Planes, pf: str):
    return [x.reshape(*x.shape[:-2], -1, 2, x.shape[-1])[..., ::-1, :].reshape(x.shape) if x.shape[-2] % 2 == 0 else x for x in p], pf


def colour_space(pf_out: str):
    """Between the planar YUV kinds and planar R'G'B' (BT.601, studio range)."""

    def kernel(p: Planes, pf: str):
        if pf == pf_out:
            return p, pf
        h, w = p[0].shape[-2:]
        full = lambda c: _wide(c, h, w).astype(float)
        if pf == "rgb24p":
            r, g, b = (x.astype(float) for x in p)
            y, u, v = 16 + (65.738 * r + 129.057 * g + 25.064 * b) / 256, 128 + (-37.945 * r - 74.494 * g + 112.439 * b) / 256, 128 + (112.439 * r - 94.154 * g - 18.285 * b) / 256
        else:
            y = p[0].astype(float)
            u, v = (full(c) for c in p[1:3]) if len(p) > 2 else (np.full(p[0].shape, 128.0),) * 2
        if pf_out == "rgb24p":
            c, d, e = 1.164383 * (y - 16), u - 128, v - 128
            return [_clip(c + 1.596027 * e + 0.5), _clip(c - 0.391762 * d - 0.812968 * e + 0.5), _clip(c + 2.017232 * d + 0.5)], pf_out
        out = [_clip(y)]
        for chroma_plane, (ch, cw) in zip((u, v), plane_shapes(pf_out, w, h)[1:], strict=False):
            dy, dx = -(-h // ch), -(-w // cw)
            even = np.pad(chroma_plane, [(0, 0)] * (chroma_plane.ndim - 2) + [(0, ch * dy - h), (0, cw * dx - w)], mode="edge")
            out.append(_clip(even.reshape(*even.shape[:-2], ch, dy, cw, dx).mean((-3, -1)) + 0.5))
        return out, pf_out

    return kernel


def blend(background: np.ndarray, over: np.ndarray, alpha: np.ndarray, x: int, y: int, mix: float = 1.0) -> np.ndarray:
    """over at (x, y) of a plane, weighted by its alpha and mix."""
    out = background.astype(float)
    h, w = min(over.shape[-2], out.shape[-2] - y), min(over.shape[-1], out.shape[-1] - x)
    a = alpha[..., :h, :w] / 255.0 * mix
    out[..., y : y + h, x : x + w] = out[..., y : y + h, x : x + w] * (1 - a) + over[..., :h, :w] * a
    return _clip(out + 0.5)


def composite(df: DataFrame, background: str, over: str, column: str, mode: str = "fill", mix: float = 1.0, alpha: str | None = None, area: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0), target: tuple[int, int] = (720, 576)) -> DataFrame:
    """over, fitted to the background (of size target) by a mode of payload.geometry, blended into it by its alpha (grey8; none: opaque) and mix.

    What the geometry cuts of the source is cut, the rest scaled; chroma planes go by their share. A null in either: the background.
    """
    from cadenza.operators.payload import geometry

    places = geometry(mode, (F.col(f"{over}.width"), F.col(f"{over}.height")), target, area=area)
    names = list(places)

    def work(batches: Iterator[tuple[pd.DataFrame, ...]]) -> Iterator[pd.DataFrame]:
        for back, front, mask, place in batches:
            frame = pd.concat([back, front.add_prefix("o_"), mask.add_prefix("a_"), place], axis=1).reset_index(drop=True)
            for k in ("pf", "width", "height"):
                frame[f"o_{k}"] = frame[f"o_{k}"].fillna(frame[k])

            def made(f: pd.DataFrame) -> tuple[Planes, str]:
                under = planes_of(f)
                pf = f["pf"].iloc[0]
                if f["o_planes"].isna().any():
                    return under, pf
                g = {k: int(f[k].iloc[0]) for k in names}
                part = lambda q: f[[f"{q}_{k}" for k in ("pf", "width", "height", "planes")]].rename(columns=lambda c: c[2:])
                top = planes_of(part("o"))
                masks = planes_of(part("a"))[0] if f["a_planes"].notna().all() else np.full_like(top[0], 255)
                own_h, own_w = top[0].shape[-2:]
                full_h, full_w = under[0].shape[-2:]
                fit = lambda x, h, w: rescale(w, h)([x[..., g["cy"] * x.shape[-2] // own_h : -(-(g["cy"] + g["ch"]) * x.shape[-2] // own_h), g["cx"] * x.shape[-1] // own_w : -(-(g["cx"] + g["cw"]) * x.shape[-1] // own_w)]], "grey8")[0][0]
                out = []
                for u, t in zip(under, top, strict=False):
                    sy, sx = full_h // u.shape[-2], full_w // u.shape[-1]
                    h, w = max(1, g["h"] // sy), max(1, g["w"] // sx)
                    out.append(blend(u, fit(t, h, w), fit(masks, h, w), g["x"] // sx, g["y"] // sy, mix))
                return out, pf

            frame["_has"] = frame["o_planes"].notna() & (frame["a_planes"].notna() | True)
            yield _stacked(frame, made, ("pf", "width", "height", "o_pf", "o_width", "o_height", "_has", *names))

    work.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, ...]], "return": Iterator[pd.DataFrame]}
    none = F.lit(None).cast(IMAGE)
    place = F.struct(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in places.items()))
    return df.withColumn(column, F.when(F.col(background).isNotNull(), F.pandas_udf(work, IMAGE)(background, over, F.col(alpha) if alpha else none, place)))


def extract_alpha(df: DataFrame, column: str, alpha: str) -> DataFrame:
    """The alpha image in place of the image, or else the image's own alpha plane; an image without either stays. alpha is null then."""
    image = F.col(column)
    own = F.when(image["pf"] == "yuva444p", F.struct(F.lit("grey8").alias("pf"), image["width"].alias("width"), image["height"].alias("height"), F.slice(image["planes"], 4, 1).alias("planes")))
    return df.withColumn(column, F.when(image.isNotNull(), F.coalesce(F.col(alpha), own, image))).withColumn(alpha, F.lit(None).cast(IMAGE))


def merge_alpha(df: DataFrame, column: str, alpha: str) -> DataFrame:
    """The first plane of the alpha image as the alpha of an image that has one and its size; others stay. Without alpha image, all stay."""
    image, mask = F.col(column), F.col(alpha)
    fits = (image["pf"] == "yuva444p") & (image["width"] == mask["width"]) & (image["height"] == mask["height"])
    return df.withColumn(column, F.when(fits, image.withField("planes", F.concat(F.slice(image["planes"], 1, 3), F.slice(mask["planes"], 1, 1)))).otherwise(image))


def field_order(df: DataFrame, column: str, order: int = 2, own: str = "field_order") -> DataFrame:
    """Images whose fields are in the other order (own: 0 progressive, 1 top first, 2 bottom first) paired anew with the image before.

    To 2: first lines of the image, second ones of the one before; to 1 the other way round. The first image repeats its
    first lines. Progressive images and those in order stay.
    """
    from cadenza.operators.windows import lagged

    def work(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for now, before in batches:
            frame = pd.concat([now, before.add_prefix("b_")], axis=1).reset_index(drop=True)
            frame["b_planes"] = [b if b is not None else None for b in frame["b_planes"]]
            frame["_has"] = frame["b_planes"].notna()

            def made(f: pd.DataFrame) -> tuple[Planes, str]:
                p = planes_of(f)
                if f["_has"].iloc[0]:
                    q = planes_of(f[["b_pf", "b_width", "b_height", "b_planes"]].rename(columns=lambda c: c[2:]))
                    first, second, at = (p, q, 1) if order == 2 else (q, p, 1)
                else:
                    first, second, at = p, p, 0
                out = []
                for a, b in zip(first, second, strict=True):
                    x = a.copy()
                    n = x.shape[-2] // 2 * 2
                    x[..., 1:n:2, :] = b[..., at:n:2, :]
                    out.append(x)
                return out, f["pf"].iloc[0]

            yield _stacked(frame, made, ("pf", "width", "height", "_has"))

    work.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.DataFrame]], "return": Iterator[pd.DataFrame]}
    wrong = F.col(column).isNotNull() & ~F.col(own).isin(0, order) if order else F.lit(False)
    rows = lagged(df, column, "_before")
    new = F.when(wrong, F.pandas_udf(work, IMAGE)(column, "_before")).otherwise(F.col(column))
    return rows.withColumns({column: new, own: F.when(wrong, F.lit(order)).otherwise(F.col(own))}).drop("_before")


#: Samples a bit, bits, and the two codes' samples: the number, then its complement, from the first luma sample on.
CELL, BITS = 5, 32
CODE = 2 * CELL * BITS


def write_codes(df: DataFrame, column: str, number: str) -> DataFrame:
    """The low 32 bits of the number of each row, then their complement, written into the first 320 luma samples, line after line: five a bit, 235 or 16.

    Images of fewer luma samples stay as they are.
    """

    def work(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        for images, numbers in batches:
            frame = images.assign(code=numbers.to_numpy()).reset_index(drop=True)

            def made(f: pd.DataFrame) -> tuple[Planes, str]:
                p = planes_of(f)
                y = p[0].copy()
                flat = y.reshape(len(y), -1)
                if flat.shape[1] >= CODE:
                    bits = (f["code"].to_numpy(np.int64)[:, None] >> np.arange(BITS)) & 1
                    flat[:, :CODE] = np.where(np.hstack([bits, 1 - bits]), 235, 16).repeat(CELL, 1)
                return [y, *p[1:]], f["pf"].iloc[0]

            yield _stacked(frame, made)

    work.__annotations__ = {"batches": Iterator[tuple[pd.DataFrame, pd.Series]], "return": Iterator[pd.DataFrame]}
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.pandas_udf(work, IMAGE)(column, number)))


def read_code(y: np.ndarray) -> int | None:
    """The number in a luma plane, by the majority of each bit's samples; None if the complement doesn't agree, so that it is damaged or there is none."""
    if y.size < CODE:
        return None
    bits = (y.reshape(-1)[:CODE].reshape(2, BITS, CELL) >= 128).sum(-1) * 2 >= CELL
    return None if (bits[0] == bits[1]).any() else sum(1 << k for k in np.flatnonzero(bits[0]).tolist())


def read_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """The number in each image, null where it is damaged or the image is null."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            yield pd.Series([None if p is None else read_code(np.frombuffer(p[0], np.uint8)) for p in frame["planes"]], dtype="Int64")

    work.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(name, F.pandas_udf(work, "long")(column))


def mask_first_line(p: Planes, pf: str):
    """The first luma line covered by the second."""
    y = p[0].copy()
    if y.shape[-2] > 1:
        y[..., 0, :] = y[..., 1, :]
    return [y, *p[1:]], pf


def decode_codes(df: DataFrame, column: str, name: str, tries: int = 3, mask: bool = True) -> DataFrame:
    """read_codes over a clip as a decoder goes through it: after tries frames without a number it gives up, and later ones have null.

    With mask, frames from the first number on (until it gives up, but for the frame at which it does if no number was found) get their first line covered.
    """
    from cadenza.operators.windows import running_sum

    read = read_codes(df, column, name)
    judged = F.when(F.col(column).isNull(), 0)
    read = read.withColumns({"_miss": judged.when(F.col(name).isNull(), 1).otherwise(0), "_hit": F.when(F.col(name).isNotNull(), 1).otherwise(0)})
    tried = running_sum(running_sum(read, "_miss", "_missed", before=True), "_hit", "_found")
    at_work = F.col("_missed") < tries
    # Numbers after the last try aren't found; those before are, also for frames without one.
    out = tried.withColumn(name, F.when(at_work, F.col(name)))
    if mask:
        covered = apply(out.withColumn("_own", F.when(at_work & (F.col("_found") > 0), F.col(column))), "_own", mask_first_line)
        out = covered.withColumn(column, F.coalesce("_own", column)).drop("_own")
    return out.drop("_miss", "_hit", "_missed", "_found")


def waveform(samples: np.ndarray, width: int = 64, height: int = 32) -> np.ndarray:
    """Pictures of samples in -1..1 (the last axis): white where a column's range passes."""
    n = samples.shape[-1]
    if not n:
        return np.full((*samples.shape[:-1], height, width), 16, np.uint8)
    edges = np.linspace(0, n, width + 1).astype(int)[:-1]  # where two are equal, reduceat takes the one sample there
    lo, hi = (((1 - f.reduceat(samples, edges, -1).clip(-1, 1)) / 2 * (height - 1)).astype(int)[..., None, :] for f in (np.maximum, np.minimum))
    line = np.arange(height)[:, None]
    return np.where((line >= lo) & (line <= hi), np.uint8(235), np.uint8(16))


def drawn(series: pd.Series, pf: str, width: int, height: int, planes: Callable[[np.ndarray], list[np.ndarray]], most: int = 1 << 22) -> pd.DataFrame:
    """A picture of each row's samples, null for null ones: planes gives those of rows of one length (rows x samples), in parts of bounded size."""
    out: list = [(None,) * 4] * len(series)
    series = series.reset_index(drop=True)
    known = series[series.notna()]
    step = max(1, most // max(1, width * height))
    for _, at in known.groupby(known.map(len)).groups.items():
        for a in range(0, len(at), step):
            part = at[a : a + step]
            raw = planes(np.array([np.asarray(v, float) for v in known[part]]))
            for k, i in enumerate(part):
                out[i] = (pf, width, height, [p[k].tobytes() for p in raw])
    return pd.DataFrame(out, columns=["pf", "width", "height", "planes"])


def visualise(df: DataFrame, samples: str, column: str, width: int = 64, height: int = 32) -> DataFrame:
    """A grey8 picture of each row's samples (-1 to 1); a null for null samples."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            yield drawn(series, "grey8", width, height, lambda x: [waveform(x, width, height)])

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return df.withColumn(column, F.when(F.col(samples).isNotNull(), F.pandas_udf(work, IMAGE)(samples)))


def planar(df: DataFrame, values: str, column: str, pf: str, width: int, height: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """An array of numbers as the planes of an image, one after another; low is 0 and high 255."""
    shapes = plane_shapes(pf, width, height)
    edges = np.cumsum([0, *(h * w for h, w in shapes)]).tolist()

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            rows = [_clip(np.floor((np.asarray(v[: edges[-1]], float) - low) / (high - low) * 255 + 0.5)) for v in series]
            yield pd.DataFrame([(pf, width, height, [x[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]) for x in rows], columns=["pf", "width", "height", "planes"])

    work.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return df.withColumn(column, F.pandas_udf(work, IMAGE)(values))


def grey(df: DataFrame, values: str, column: str, width: int, height: int, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """An array of numbers as a grey8 image, low black and high white."""
    return planar(df, values, column, "grey8", width, height, low, high)
