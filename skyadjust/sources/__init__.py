"""Readers and writers of images, cameras, stage artefacts and configuration."""
