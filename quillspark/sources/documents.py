"""Text of knowledge files, by suffix, with a cache by content.

Extractors are callables from bytes to parts of text.  Plain text and Markdown
need nothing; PDF, slides and images need libraries that may be absent, and are
offered only where they can be imported.  Recognition is an injected callable
from the bytes of a picture to its text; ``Reading`` says when it is asked.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IngestError

#: (text, location, method, page, slide) of each part of a file.
Part = tuple[str, str, str, int | None, int | None]
Extractor = Callable[[bytes], list[Part]]

# Limits of one document.
MOST_BYTES, MOST_PAGES, MOST_PIXELS, MOST_UNPACKED = 20 * 1024 * 1024, 100, 20_000_000, 100 * 1024 * 1024
# Dots per inch of a page's picture, and per inch of its own measure.
PICTURE_DPI, PAGE_DPI = 150, 72
# How places are named.
PAGE, PICTURE, SLIDE, INNER = "第{}页", "图片第{}页", "幻灯片{}", {"table": "表格", "ocr": "图片", "notes": "备注"}
PARTS = "array<struct<text:string,location:string,method:string,page:int,slide:int>>"


@dataclass(frozen=True)
class Reading:
    """``auto`` recognizes where the text layer may lack something, ``always`` every page, ``off`` nothing."""

    recognize: Callable[[bytes], str] | None = None
    mode: str = "auto"

    def wanted(self, text: str, pictures: bool) -> bool:
        return self.mode == "always" or (self.mode == "auto" and (not text or pictures))

    def read(self, picture: bytes, width: float = 0, height: float = 0) -> str:
        if self.mode == "off" or self.recognize is None:
            raise IngestError("this needs text recognition, which is off")
        if width * height > MOST_PIXELS:
            raise IngestError(f"a picture has more than {MOST_PIXELS} pixels")
        return self.recognize(picture).strip()


def plain_text(raw: bytes) -> list[Part]:
    return [(raw.decode("utf-8", "replace"), "", "native", None, None)]


def together(native: str, recognized: str) -> str:
    """The native text, and the recognized lines that it lacks but for white space; its own repeated lines stay."""
    known = {"".join(line.split()) for line in native.splitlines()}
    return "\n".join([native.strip(), *(line for line in recognized.splitlines() if "".join(line.split()) not in known | {""})]).strip()


def page_parts(pages: Iterable, reading: Reading) -> Iterator[Part]:
    """Parts of the pages of an opened PDF; a page with neither text nor anything recognized has none."""
    for number, page in enumerate(pages, 1):
        text, method = page.get_text("text", sort=True).strip(), "native"
        if reading.wanted(text, bool(page.get_images())):
            if reading.recognize is None and text and reading.mode == "auto":
                pass  # nothing to recognize with; the text layer is all there is
            else:
                scale = PICTURE_DPI / PAGE_DPI
                if page.rect.width * page.rect.height * scale**2 > MOST_PIXELS:
                    raise IngestError(f"page {number} has more than {MOST_PIXELS} pixels")
                seen = reading.read(page.get_pixmap(dpi=PICTURE_DPI, alpha=False).tobytes("png"))
                text, method = together(text, seen), "native+ocr" if text else "ocr"
        elif not text:
            raise IngestError(f"page {number} has no text layer, and recognition is off")
        if text:
            yield text, PAGE.format(number), method, number, None


def flat(shapes: Iterable) -> Iterator:
    """Shapes with those of their groups."""
    for shape in shapes:
        if hasattr(shape, "shapes"):
            yield from flat(shape.shapes)
        else:
            yield shape


def slide_parts(slides: Iterable, reading: Reading) -> Iterator[Part]:
    """Parts of the slides: their texts together, then each table and picture, then the notes."""
    for number, slide in enumerate(slides, 1):
        title = slide.shapes.title.text.strip() if slide.shapes.title is not None else ""
        place = SLIDE.format(number) + (f"：{title}" if title else "")
        shapes = list(flat(slide.shapes))
        texts = [s.text.strip() for s in shapes if getattr(s, "has_text_frame", False) and s.text.strip()]
        found = [("\n".join(texts), "native")] if texts else []
        for shape in shapes:
            if getattr(shape, "has_table", False):
                found.append(("\n".join("\t".join(cell.text for cell in row.cells) for row in shape.table.rows), "table"))
            if hasattr(shape, "image") and reading.mode != "off" and reading.recognize is not None:
                found.append((reading.read(shape.image.blob), "ocr"))
        if slide.has_notes_slide and slide.notes_slide.notes_text_frame is not None:
            found.append((slide.notes_slide.notes_text_frame.text, "notes"))
        for text, method in found:
            if text.strip():
                yield text, place if method == "native" else f"{place} > {INNER[method]}", method, None, number


def frame_parts(frames: Iterable, reading: Reading) -> Iterator[Part]:
    """Parts of the frames of a picture, given as (width, height, bytes)."""
    for number, (width, height, picture) in enumerate(frames, 1):
        text = reading.read(picture, width, height)
        if text:
            yield text, PICTURE.format(number), "ocr", number, None


def pdf_extractor(reading: Reading) -> Extractor:
    def run(raw: bytes) -> list[Part]:
        import fitz  # PyMuPDF

        with fitz.open(stream=raw, filetype="pdf") as document:
            if document.needs_pass:
                raise IngestError("the file is encrypted")
            if document.page_count > MOST_PAGES:
                raise IngestError(f"more than {MOST_PAGES} pages")
            return list(page_parts(document, reading))

    return run


def slides_extractor(reading: Reading) -> Extractor:
    def run(raw: bytes) -> list[Part]:
        from pptx import Presentation

        with zipfile.ZipFile(io.BytesIO(raw)) as packed:
            if sum(f.file_size for f in packed.infolist()) > MOST_UNPACKED:
                raise IngestError(f"more than {MOST_UNPACKED} bytes unpacked")
        slides = Presentation(io.BytesIO(raw)).slides
        if len(slides) > MOST_PAGES:
            raise IngestError(f"more than {MOST_PAGES} slides")
        return list(slide_parts(slides, reading))

    return run


def image_extractor(reading: Reading) -> Extractor:
    def run(raw: bytes) -> list[Part]:
        from PIL import Image

        def frames(image):
            for i in range(image.n_frames if hasattr(image, "n_frames") else 1):
                image.seek(i)
                held = io.BytesIO()
                image.save(held, format="PNG")
                yield image.width, image.height, held.getvalue()

        with Image.open(io.BytesIO(raw)) as image:
            if getattr(image, "n_frames", 1) > MOST_PAGES:
                raise IngestError(f"more than {MOST_PAGES} pictures")
            return list(frame_parts(frames(image), reading))

    return run


#: Extractors that need a library, which may be absent: suffixes, library, maker.
OPTIONAL = [(("pdf",), "fitz", pdf_extractor), (("pptx",), "pptx", slides_extractor), (("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp"), "PIL", image_extractor)]


def available(reading: Reading = Reading()) -> dict[str, Extractor]:
    """The extractors whose libraries are here."""
    found: dict[str, Extractor] = {"md": plain_text, "txt": plain_text}
    for suffixes, library, maker in OPTIONAL:
        try:
            __import__(library)
        except ImportError:
            continue
        found |= dict.fromkeys(suffixes, maker(reading))
    return found


def keyed(files: DataFrame, signature: str) -> DataFrame:
    """Files with ``key``: a hash of content, suffix and the parsers' version."""
    return files.withColumn("key", F.sha2(F.concat(F.col("content"), F.encode("suffix", "utf-8"), F.encode(F.lit(signature), "utf-8")), 256))


def extracted(files: DataFrame, cache: DataFrame, extractors: dict[str, Extractor], signature: str = "1") -> DataFrame:
    """(key, path, parts, error) of each file; only contents that the cache lacks are parsed, once for equal files.

    ``files`` has path, content and suffix; ``cache`` key and parts. A file that
    can't be parsed has null parts and says why; others go on.
    """

    @F.pandas_udf(f"struct<parts:{PARTS},error:string>")
    def parse(contents: pd.Series, suffixes: pd.Series) -> pd.DataFrame:
        rows = []
        for raw, suffix in zip(contents, suffixes):
            try:
                if len(raw) > MOST_BYTES:
                    raise IngestError(f"more than {MOST_BYTES} bytes")
                if suffix not in extractors:
                    raise IngestError(f"no extractor for .{suffix} here")
                names = ("text", "location", "method", "page", "slide")
                rows.append(([dict(zip(names, part)) for part in extractors[suffix](bytes(raw))], None))
            except Exception as wrong:
                rows.append((None, f"{type(wrong).__name__}: {wrong}"))
        return pd.DataFrame(rows, columns=["parts", "error"])

    named = keyed(files, signature)
    known = named.join(cache.select("key", "parts"), "key").select("key", "path", "parts", F.lit(None).cast("string").alias("error"))
    missing = named.join(cache.select("key"), "key", "left_anti")
    parsed = missing.dropDuplicates(["key"]).select("key", parse("content", "suffix").alias("p")).select("key", "p.parts", "p.error")
    return known.unionByName(missing.select("key", "path").join(parsed, "key").select("key", "path", "parts", "error"))
