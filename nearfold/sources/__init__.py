"""Readers: folders of images, and the driver's tables seen as images."""
