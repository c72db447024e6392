"""A recogniser that runs the tesseract program of the worker's PATH on a page."""

from __future__ import annotations

import csv
import io
import os
import subprocess

import numpy as np
import pandas as pd

COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
#: The program's names of languages that aren't their three-letter codes' first spelling.
TRAINED = {"de": "deu", "fr": "fra", "nl": "nld", "cs": "ces", "ro": "ron", "el": "ell", "zh": "chi_sim", "sk": "slk", "is": "isl", "eu": "eus"}


def trained_name(language: str | None) -> str | None:
    from glyphstream.sources.files import ALPHA3

    base = (language or "").split("-")[0]
    return TRAINED.get(base) or next((three for three, two in ALPHA3.items() if two == base), None)


def words(tsv: str) -> pd.DataFrame:
    """COLUMNS of the program's table; numbers as integers, confidence as it stands."""
    rows = list(csv.DictReader(io.StringIO(tsv), delimiter="\t", quoting=csv.QUOTE_NONE))
    return pd.DataFrame([[r[c] or "" for c in COLUMNS] for r in rows], columns=COLUMNS).astype({c: int for c in COLUMNS[:-2]})


def tesseract(page: np.ndarray, options) -> pd.DataFrame:
    image = b"P5 %d %d 255\n" % (page.shape[1], page.shape[0]) + np.ascontiguousarray(page).tobytes()
    name = trained_name(options.language)
    command = ["tesseract", "stdin", "stdout", "--psm", str(options.psm), "--oem", str(options.oem), *(["-l", name] if name else []), "tsv"]
    done = subprocess.run(command, input=image, capture_output=True, check=True, env=os.environ | {"OMP_THREAD_LIMIT": "1"})
    return words(done.stdout.decode("utf-8"))
