"""The shared session fixture comes from tests/conftest.py."""
