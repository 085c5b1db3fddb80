"""Lets the tests of this folder import what they share."""

from __future__ import annotations

import os
import sys

from hypothesis import settings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
settings.register_profile("plain", deadline=None, max_examples=60)
settings.load_profile("plain")
