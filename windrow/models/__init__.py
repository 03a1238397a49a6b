"""Latent-state models and what is read from them."""
