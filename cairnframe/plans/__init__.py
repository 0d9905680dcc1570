"""Logical plans assembled from operators: project files, builds, exports, registered queries."""
