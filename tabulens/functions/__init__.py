"""Scalar column expressions shared by the operators."""
