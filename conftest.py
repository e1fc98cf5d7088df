"""Puts the repository on the path of the tests."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
