"""All catalogues of the core."""

from __future__ import annotations

from kvist.plans import corpus, files, general, ranking, scoring

CATALOGUES = [general.CATALOGUE, ranking.CATALOGUE, corpus.CATALOGUE, scoring.CATALOGUE, files.CATALOGUE]
