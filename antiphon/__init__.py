"""antiphon: contrastive text and vector analytics on Spark."""
