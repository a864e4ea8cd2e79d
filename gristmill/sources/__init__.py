"""Reading collections in, writing results and versioned tables out."""
