"""tidemark: data-quality, dimensional-modelling and customer-analytics operators for Spark."""
