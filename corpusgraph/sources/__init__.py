"""Catalogs, loaders and segmentation."""
