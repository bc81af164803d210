"""Particle analytics on Spark: tables of volumes, picks, embeddings, poses and metric logs."""
