"""Subtitle-stream analytics on Spark: DataFrame plans first, Python only for binary decoding.

``scan_path``, ``rip``, ``rip_pgs``, ``tracks``, ``ScanOptions``, ``OcrOptions``, ``Rule`` and ``tesseract`` are the public surface.
"""

from __future__ import annotations

__version__ = "0.2.0"

_AT = {"scan_path": "api", "rip": "api", "rip_pgs": "api", "tracks": "api", "ScanOptions": "sources.files", "OcrOptions": "operators.recognise", "Rule": "functions.srt", "tesseract": "functions.ocr"}
__all__ = ["__version__", *_AT]


def __getattr__(name: str):
    """Public names are imported when they are first asked for: workers that need one layer don't load the others."""
    if name not in _AT:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    import importlib

    return getattr(importlib.import_module(f"{__name__}.{_AT[name]}"), name)
