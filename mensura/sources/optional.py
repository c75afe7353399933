"""Readers that need libraries which may not be installed; each says so when it is used."""

from __future__ import annotations

import importlib
from types import ModuleType


def _need(name: str) -> ModuleType:
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise RuntimeError(f"this reader needs the library {name}, which is not installed") from e


def pdf_text(content: bytes) -> list[dict]:
    """One row with the text of all pages, joined by line breaks."""
    doc = _need("fitz").open(stream=content, filetype="pdf")
    return [{"text": "\n".join(page.get_text() for page in doc)}]


def pdf_words(content: bytes) -> list[dict]:
    """A row for each word: page, x, y, text."""
    doc = _need("fitz").open(stream=content, filetype="pdf")
    return [{"page": n, "x": w[0], "y": w[1], "text": w[4]} for n, page in enumerate(doc) for w in page.get_text("words")]


def pdf_images(content: bytes, least: int = 150) -> list[dict]:
    """A row for each image that is at least so many pixels wide and high: page, nth, image."""
    doc, out = _need("fitz").open(stream=content, filetype="pdf"), []
    for n, page in enumerate(doc):
        for k, entry in enumerate(page.get_images(full=True), 1):
            image = doc.extract_image(entry[0])
            if image["width"] >= least and image["height"] >= least:
                out.append({"page": n, "nth": k, "image": image["image"]})
    return out


def ruled_tables(content: bytes) -> list[dict]:
    """A row for each cell of each ruled table of at least two rows and columns: page, nth, row_no, column_no, text."""
    io = importlib.import_module("io")
    out = []
    with _need("pdfplumber").open(io.BytesIO(content)) as doc:
        for n, page in enumerate(doc.pages):
            for k, rows in enumerate(page.extract_tables({"vertical_strategy": "lines_strict", "horizontal_strategy": "lines_strict", "snap_tolerance": 5}), 1):
                if len(rows) >= 2 and max(map(len, rows)) >= 2:
                    out += [{"page": n, "nth": k, "row_no": i, "column_no": j, "text": c} for i, r in enumerate(rows) for j, c in enumerate(r)]
    return out


def image_boxes(content: bytes, side: int = 2000) -> list[dict]:
    """A row for each piece of text read off an image: x, y (centre), text, conf. The image is grey, of more contrast and at most `side` pixels long."""
    io = importlib.import_module("io")
    image = _need("PIL.Image").open(io.BytesIO(content)).convert("L")
    image.thumbnail((side, side))
    image = _need("PIL.ImageEnhance").Contrast(image).enhance(2.0).filter(_need("PIL.ImageFilter").SHARPEN)
    found, _ = _need("rapidocr_onnxruntime").RapidOCR()(_need("numpy").array(image.convert("RGB")))
    centre = lambda box, i: sum(p[i] for p in box) / len(box)
    return [{"x": centre(box, 0), "y": centre(box, 1), "text": text, "conf": float(conf)} for box, text, conf in found or []]


def entities(text: str, model: str = "en_core_sci_md") -> list[dict]:
    """A row for each named entity of a text: text, label, start, end."""
    doc = _need("spacy").load(model)(text)
    return [{"text": e.text, "label": e.label_, "start": e.start_char, "end": e.end_char} for e in doc.ents]
